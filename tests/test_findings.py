import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteledger import schemas
from siteledger.functions.rules import FINDING_RULES, REGION_TERMS
from siteledger.functions.scalars import collapsed, fixed, link_slug, outcome, shown, stable_key
from siteledger.operators import findings, metrics

AS_OF = dt.date(2026, 7, 30)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def snapshot(spark, data):
    return spark.createDataFrame(data, "date date, page string, query string, clicks int, impressions int, position double")


def test_rules_are_whole():
    assert len(FINDING_RULES) == 23 and len({r[1] for r in FINDING_RULES}) == 23
    assert all(1 <= r[2] <= 10 and 1 <= r[3] <= 10 and r[4] in (1, 2, 3) for r in FINDING_RULES)
    assert len(REGION_TERMS) == 54


def test_sitemap_and_robots_messages(spark):
    audits = spark.createDataFrame([
        ("1", None, 2, 5, ["El XML del sitemap parece estar mal formado (no se encontró </urlset>)", "URL fuera de dominio en el sitemap: https://x.example/a", "No se pudo obtener el sitemap: 404", "otra cosa"]),
        ("2", None, 2, 0, []), ("3", None, 2, 0, None),
    ], schemas.SITEMAP_AUDIT)
    got = rows(findings.sitemap_findings(audits), "source_ref_id", "finding_type", "stable_key_input")
    assert got == [
        ("1", "sitemap-fetch-failed", "sitemap-fetch-failed"), ("1", "sitemap-malformed", "sitemap-malformed"), ("1", "sitemap-other", "otra cosa"),
        ("1", "sitemap-out-of-domain", "URL fuera de dominio en el sitemap: https://x.example/a"), ("1", "sitemap-stale-entries", "sitemap-stale-entries"),
    ]
    robots = spark.createDataFrame([("r", None, False, ["robots.txt no declara ninguna directiva Sitemap:", "robots.txt contiene 'Disallow: /' — x", "No se pudo obtener robots.txt: 500", "?"])], schemas.ROBOTS_AUDIT)
    assert [r[0] for r in rows(findings.robots_findings(robots), "finding_type")] == ["robots-blocks-all", "robots-fetch-failed", "robots-missing-sitemap-directive", "robots-other"]


def test_structured_data_branches(spark):
    audits = spark.createDataFrame([("1", None, "u", "Organization", True, []), ("2", None, "u", "none", False, ["e"]), ("3", None, "u", "invalid-json", False, ["e"]), ("4", None, "u", "DefinedTermSet", False, ["e"])], schemas.STRUCTURED_DATA_AUDIT)
    assert rows(findings.structured_data_findings(audits), "source_ref_id", "stable_key_input") == [("2", "structured-data-missing:u"), ("3", "structured-data-invalid-json:u"), ("4", "structured-data-missing-field:u:DefinedTermSet")]


def test_performance_limits_are_strict_and_nulls_pass(spark):
    audits = spark.createDataFrame([("1", None, "u", 31, 5.2, 0.4, 650.0, []), ("2", None, "u", 50, 4.0, 0.25, 500.0, []), ("3", None, "u", None, None, None, None, [])], schemas.PERFORMANCE_AUDIT)
    got = findings.performance_findings(audits)
    assert [r[1] for r in rows(got, "source_ref_id", "finding_type")] == ["performance-cls-red", "performance-inp-red", "performance-lcp-red", "performance-low-score"]
    assert "LCP en rojo (5.2s) en u" in {r.title for r in got.collect()} and "INP en rojo (650ms) en u" in {r.title for r in got.collect()}


def test_latest_batch_takes_all_rows_of_the_newest_run(spark):
    t = dt.datetime(2026, 7, 1)
    df = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(60)), ("c", t + dt.timedelta(60))], "id string, run_at timestamp")
    assert rows(findings.latest_batch(df), "id") == [("b",), ("c",)]
    assert findings.latest_batch(df.filter("id = 'z'")).count() == 0
    assert rows(findings.latest_row(df), "id") == [("b",)]


def test_declining(spark):
    d = lambda n: AS_OF - dt.timedelta(n)
    snap = snapshot(spark, [(d(3), "down", "q", 7, 1, 1.0), (d(20), "down", "q", 10, 1, 1.0), (d(3), "held", "q", 9, 1, 1.0), (d(20), "held", "q", 10, 1, 1.0), (d(20), "gone", "q", 10, 1, 1.0), (d(3), "new", "q", 1, 1, 1.0), (d(3), "zero", "q", 0, 1, 1.0), (d(20), "zero", "q", 0, 1, 1.0)])
    assert rows(metrics.declining_pages(snap, AS_OF), "page", "prior_clicks", "recent_clicks") == [("down", 10, 7)]
    assert {r[0] for r in rows(metrics.declining_pages(snap, AS_OF, include_vanished=True), "page")} == {"down", "gone"}
    assert metrics.declining_findings(snap, AS_OF).first().title == "down ha bajado un 30% en clics (10 → 7)"
    assert rows(metrics.clicks_by_page(metrics.recent(snap, AS_OF)), "page", "clicks") == [("down", 7), ("held", 9), ("new", 1), ("zero", 0)]


def test_window_edges(spark):
    snap = snapshot(spark, [(AS_OF - dt.timedelta(n), str(n), "q", 1, 1, 1.0) for n in (0, 14, 15, 28, 29)])
    assert {r.page for r in metrics.recent(snap, AS_OF).collect()} == {"0", "14"}
    assert {r.page for r in metrics.prior(snap, AS_OF).collect()} == {"15", "28"}


def test_competing_pages_and_query_gaps(spark):
    snap = snapshot(spark, [(AS_OF, "b", "x", 0, 10, 1.0), (AS_OF, "a", "x", 0, 10, 1.0), (AS_OF, "a", "y", 0, 10, 1.0), (AS_OF, "p", "g", 20, 5000, 15.0), (AS_OF, "p", "h", 500, 5000, 3.0), (AS_OF - dt.timedelta(1), "p", "g", 1, 9000, 12.0), (AS_OF, "p", "z", 0, 0, 50.0)])
    assert rows(metrics.competing_pages(snap, AS_OF), "query", "pages") == [("x", ["a", "b"])]
    assert rows(metrics.query_gaps(snap, AS_OF), "page", "query", "impressions") == [("p", "g", 5000)]
    assert metrics.query_gap_findings(snap, AS_OF).first().title == '"g" tiene 5000 impresiones pero posición 15.0 en p'


def test_scored_has_one_row_a_key_and_ignores_the_reference(spark):
    f = spark.createDataFrame([("robots", "robots-blocks-all", "robots-blocks-all", "t", "d", "1"), ("robots", "robots-blocks-all", "robots-blocks-all", "t", "d", "2")], schemas.FINDING)
    got = findings.scored(f).collect()
    assert len(got) == 1 and got[0].priority_score == 10.0 and got[0].tier == 1 and got[0].source_ref_id == "2"
    import hashlib

    assert got[0].stable_key == hashlib.sha256(b"robots:robots-blocks-all").hexdigest()


def test_all_current_findings(spark):
    audits = spark.createDataFrame([("1", dt.datetime(2026, 7, 1), 1, 1, ["x"])], schemas.SITEMAP_AUDIT)
    links = spark.createDataFrame([("k", "c/a", "c/b", 0.5, "open"), ("l", "c/a", "c/c", 0.5, "dismissed")], schemas.LINK_SUGGESTION)
    got = findings.current_findings(AS_OF, sitemap=audits, suggestions=links)
    assert [r[0] for r in rows(got, "finding_type")] == ["internal-link-suggestion", "sitemap-other", "sitemap-stale-entries"]


@pytest.mark.parametrize("before,after,want", [(100.0, 84.0, "negative"), (100.0, 85.0, "negative"), (100.0, 86.0, "positive"), (100.0, 150.0, "positive"), (0.0, 5.0, "inconclusive"), (0.0, 0.0, "inconclusive")])
def test_outcome(spark, before, after, want):
    assert spark.range(1).select(outcome(F.lit(before), F.lit(after))).first()[0] == want


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(collapsed(F.lit("﻿ a \n b  "))) == "a b"
    assert get(link_slug(F.lit("https://x.example/blog/c/a/?q=1"))) == "c/a"
    assert get(link_slug(F.lit("/about"))) == ""
    assert get(shown(F.lit(5.0))) == "5" and get(shown(F.lit(5.2))) == "5.2" and get(fixed(F.lit(0.456), 2)) == "0.46"
    assert len(get(stable_key(F.lit("a"), F.lit("b")))) == 64
