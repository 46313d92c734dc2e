import datetime as dt
import json

from siteledger.operators import documents
from pyspark.sql import functions as F

from siteledger.sinks import append_batch, append_once, upsert_by_date, write_text
from siteledger.sources import landing
from siteledger.streaming import daily_totals, latest_health, run_to_end, stream_responses, upsert_stream

NOW = dt.datetime(2026, 7, 1)


def test_robots(spark):
    docs = spark.createDataFrame([("ok", "User-agent: *\nDisallow: /admin/\n\t SITEMAP: /s.xml\r", None), ("none", "Disallow: /admin/", None), ("all", "disallow:  / \nsitemap: x", None), ("failed", None, "robots.txt fetch failed: 404")], "site string, body string, fetch_error string")
    got = {r.site: (r.is_valid, len(r.errors)) for r in documents.audit_robots(docs).collect()}
    assert got == {"ok": (True, 0), "none": (False, 1), "all": (False, 1), "failed": (False, 1)}


def test_sitemaps(spark):
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    rows = [
        ("two", "https://s.example", f"{head}<url><loc> https://s.example/a </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://s.example/b</loc></url></urlset>", None),
        ("cut", "https://s.example", f"{head}<url><loc>not closed", None), ("foreign", "https://s.example", f"{head}<url><loc>https://other.example/x</loc><lastmod>soon</lastmod></url></urlset>", None),
        ("failed", "https://s.example", None, "500"),
    ]
    got = {r.site: (r.url_count, r.stale_entries, r.errors) for r in documents.audit_sitemaps(spark.createDataFrame(rows, "site string, base_url string, body string, fetch_error string"), NOW).collect()}
    assert got["two"] == (2, 1, [])
    assert got["cut"][:2] == (0, 0) and got["cut"][2][0].startswith("El XML del sitemap parece estar mal formado")
    assert got["foreign"] == (1, 0, ["URL fuera de dominio en el sitemap: https://other.example/x"])
    assert got["failed"] == (0, 0, ["No se pudo obtener el sitemap: 500"])


def test_published_articles(spark):
    body = "<urlset>" + "".join(f"<url><loc>https://s.example/{p}</loc></url>" for p in ("blog/c/a", "blog/b", "about", "blog/", "blog/b")) + "</urlset>"
    got = documents.published_articles(spark.createDataFrame([(body,)], "body string"), "https://s.example")
    assert sorted(r.slug for r in got.collect()) == ["b", "c/a"]


def pages(spark, *html):
    return documents.extract_pages(spark.createDataFrame([(str(n), h, None) for n, h in enumerate(html)] + [("failed", None, "404")], "url string, html string, fetch_error string"))


def test_article_text(spark):
    got = {r.url: r.text for r in documents.article_texts(pages(
        spark,
        "<body><nav>menu</nav><article><h1>T</h1> <p>one\n two<br>three <script>x()</script></p></article><article>second</article><footer>f</footer></body>",
        "<main>outer<main><header>inner head</header> text</main>after</main>",
        "<html><head><title>t</title></head><body><header>h</header>kept <aside>a</aside><style>s</style>too",
    )).collect()}
    assert got == {"0": "T one twothree", "1": "inner head text", "2": "kept too", "failed": None}


def test_links(spark):
    got = documents.linked_slugs(pages(spark, '<a href="/blog/c/a/">x</a><a href="https://s.example/blog/b?x#y">y</a><a href="/blog/b">z</a><a href="/blog/">none</a><a>no</a>'))
    assert sorted(r.slug for r in got.collect()) == ["b", "c/a"]


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_structured_data(spark):
    got = documents.audit_structured_data(pages(
        spark,
        ld(json.dumps({"@type": "Article", "headline": "h", "author": {"name": "a"}, "datePublished": "2026"})),
        ld('{"@type": "Article", "headline": "", "author": null}'), "<p>nothing</p>",
        ld('[{"@type": "Organization", "name": "n"}, {"@type": "WebSite", "name": 0, "url": false}, 7]'), ld("{not json"), ld('{"name": "no type"}', "[]"),
    )).collect()
    by = {}
    for r in got:
        by.setdefault(r.url, []).append((r.schema_type, r.is_valid, len(r.errors)))
    assert by["0"] == [("Article", True, 0)]
    assert by["1"] == [("Article", False, 3)]
    assert by["2"] == [("none", False, 1)] and by["failed"] == [("none", False, 1)]
    assert sorted(by["3"]) == [("Organization", False, 1), ("WebSite", True, 0), ("invalid-json", False, 1)]
    assert by["4"] == [("invalid-json", False, 1)]
    assert by["5"] == [("unknown", True, 0)]


def report(score, lcp, cls, inp):
    return json.dumps({"lighthouseResult": {"categories": {"performance": {"score": score}}, "audits": {"largest-contentful-paint": {"numericValue": lcp}, "cumulative-layout-shift": {"numericValue": cls}}}, "loadingExperience": {"metrics": {"INTERACTION_TO_NEXT_PAINT": {"percentile": inp}}}})


def test_page_speed(spark):
    rows = [("a", report(0.92, 1800, 0.05, 180), None), ("b", report(0.31, 5200, 0.4, 650), None), ("c", "{}", None), ("d", None, "PSI request failed: 500"), ("e", "{", None), ("f", report(0.925, 1, 1, 1), None)]
    got = {r.url: tuple(r[1:5]) + (len(r.errors),) for r in landing.page_speed(spark.createDataFrame(rows, landing.SPEED_REPORT)).collect()}
    assert got["a"] == (92, 1.8, 0.05, 180.0, 0) and got["b"] == (31, 5.2, 0.4, 650.0, 0) and got["f"][0] == 93
    assert got["c"] == (None,) * 4 + (0,) and got["d"] == (None,) * 4 + (1,) and got["e"] == (None,) * 4 + (1,)


def test_responses(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"rows": [{"keys": ["2026-07-01", "p", "q"], "clicks": 12, "impressions": 340, "ctr": 0.035, "position": 8.2}, {"keys": ["2026-07-02"]}]}))
    assert sorted(map(tuple, landing.read_search(spark, str(tmp_path)).collect())) == [(dt.date(2026, 7, 1), "p", "q", 12, 340, 0.035, 8.2), (dt.date(2026, 7, 2), "", "", 0, 0, 0.0, 0.0)]
    other = tmp_path / "t"
    other.mkdir()
    (other / "t.json").write_text(json.dumps({"rows": [{"dimensionValues": [{"value": "20260701"}, {"value": "/p"}, {"value": "Organic Search"}], "metricValues": [{"value": "42"}, {"value": "x"}]}]}))
    assert list(map(tuple, landing.read_traffic(spark, str(other)).collect())) == [(dt.date(2026, 7, 1), "/p", "Organic Search", 42, 0, 0)]
    rows = spark.createDataFrame([(dt.date(2026, 7, n),) for n in range(1, 10)], "date date")
    assert [r.date.day for r in landing.collection_window(rows, dt.date(2026, 7, 8)).orderBy("date").collect()] == [5, 6, 7, 8]


KEYS = ["date", "page", "query"]


def snap(spark, *rows):
    return spark.createDataFrame([(dt.date(2026, 7, d), "p", q, n) for d, q, n in rows], "date date, page string, query string, clicks int")


def test_upsert_by_date(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: sorted((r.date.day, r.query, r.clicks) for r in spark.read.parquet(path).collect())
    upsert_by_date(snap(spark, (1, "a", 5), (2, "a", 5)), path, KEYS)
    upsert_by_date(snap(spark, (2, "a", 9), (2, "b", 1)), path, KEYS)
    upsert_by_date(snap(spark, (2, "a", 9)), path, KEYS)
    assert read() == [(1, "a", 5), (2, "a", 9), (2, "b", 1)]


def test_upsert_keeps_what_arrived_last(spark, tmp_path):
    """Lower corrections count, and rows without a date are found again."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(dt.date(2026, 7, 2), "p", "a", 9, 1), (dt.date(2026, 7, 2), "p", "a", 4, 2), (None, "p", "a", 7, 1)], "date date, page string, query string, clicks int, place int")
    upsert_by_date(rows, path, KEYS, ["place"])
    upsert_by_date(rows.filter("date is null").withColumn("clicks", F.lit(3)), path, KEYS, ["place"])
    assert sorted((str(r.date), r.clicks) for r in spark.read.parquet(path).collect()) == [("2026-07-02", 4), ("None", 3)]


def test_appends(spark, tmp_path):
    path, once = str(tmp_path / "a"), str(tmp_path / "o")
    rows = spark.createDataFrame([("x",), ("y",)], "change_id string")
    append_batch(rows, path, NOW)
    assert {r.run_at for r in spark.read.parquet(path).collect()} == {NOW}
    append_once(rows, once, "change_id")
    append_once(rows, once, "change_id")
    assert spark.read.parquet(once).count() == 2
    write_text(spark.createDataFrame([("# B",)], "value string"), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).first().value == "# B"


def test_streams(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    row = lambda q, n: {"keys": ["2026-07-01", "p", q], "clicks": n, "impressions": 1, "ctr": 0.0, "position": 1.0}
    for name, rows in (("1", [row("a", 5), row("b", 1)]), ("2", [row("a", 9)])):
        (land / f"{name}.json").write_text(json.dumps({"rows": rows}))
        upsert_stream(stream_responses(spark, str(land)), out, KEYS, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.query, r.clicks) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 1)]


def test_streaming_totals_and_health(spark, tmp_path):
    data = str(tmp_path / "e")
    spark.createDataFrame([(dt.datetime(2026, 7, 1, 3), "p", 2), (dt.datetime(2026, 7, 1, 9), "p", 3), (dt.datetime(2026, 7, 2), "p", 4)], "ts timestamp, page string, clicks long").write.parquet(data)
    kept = []
    stream = spark.readStream.schema("ts timestamp, page string, clicks long").parquet(data)
    run_to_end(daily_totals(stream), lambda df, _: kept.extend(df.collect()), str(tmp_path / "c1"), "update")
    assert sorted((r.day.day, r.clicks) for r in kept) == [(1, 5), (2, 4)]
    steps = str(tmp_path / "w")
    spark.createDataFrame([("a", dt.date(2026, 7, 1), "failure"), ("a", dt.date(2026, 7, 2), "success"), ("b", dt.date(2026, 7, 2), "failure")], "workflow string, run_on date, outcome string").write.parquet(steps)
    kept.clear()
    stream = spark.readStream.schema("workflow string, run_on date, outcome string").parquet(steps)
    run_to_end(latest_health(stream), lambda df, _: kept.extend(df.collect()), str(tmp_path / "c2"), "update")
    assert {r.workflow: r.status for r in kept} == {"a": "ok", "b": "failed"}


def test_references_without_semicolon_in_query_and_sql(spark, tmp_path):
    """a title cut within &amp; ends in &amp, which HTML reads as & too."""
    import duckdb

    from siteledger.plans import oracle, queries

    html = ["<article><h1>a &amp;&amp</h1>b &lt;i&gt; &copy x &amp;lt; y</article>", "<article>&amp</article>", "<article>&middot;&quot &amp;amp</article>"]
    rows = [(n, f"https://x.example/{n}", x) for n, x in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.article_text(spark, str(tmp_path)).collect()))
    assert [t for _, t in got] == ["a &&b <i> © x &lt; y", "&", '·" &amp']
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(oracle.ORACLE_SQL["article_text"]).fetchall()) == got


def test_few_parsed_pages_are_held_at_once():
    """of a large batch, parts of a few pages at a time are given back."""
    import pyarrow as pa

    html = ["<a href='/x'>y</a>" + "z" * 300_000, None] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(40)]), pa.array(html), pa.array([None, "gone"] * 20)], names=["url", "html", "fetch_error"])
    out = list(documents.parsed_pages(iter([batch, batch[:0]])))
    assert len(out) == 3 and [x for b in out for x in b["url"].to_pylist()] == [str(n) for n in range(40)]
    rows = pa.Table.from_batches(out).to_pylist()
    assert rows[38]["hrefs"] == ["/x"] and rows[39] == {"url": "39", "fetch_error": "gone", "raw": "", "hrefs": [], "blocks": []}
