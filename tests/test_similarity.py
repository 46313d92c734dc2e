import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from siteledger import schemas
from siteledger.functions.scalars import link_key
from siteledger.operators import architecture, similarity
from siteledger.plans import queries
from siteledger.sources import views


def articles(spark, **vectors):
    return spark.createDataFrame([(k.replace("__", "/"), [float(x) for x in v]) for k, v in vectors.items()], "slug string, embedding array<float>")


def test_near_duplicates(spark):
    a = articles(spark, c__a=[1, 0, 0], c__b=[0.99, 0.01, 0], c__c=[0, 1, 0], c__d=[0.5, 0.5, 0], c__z=[0, 0, 0])
    for blocks in (1, 2, 3, 8):
        got = similarity.near_duplicate_pairs(a, blocks=blocks).collect()
        assert [(r.slug_a, r.slug_b) for r in got] == [("c/a", "c/b")]
    assert similarity.near_duplicate_pairs(a.filter("false"), blocks=2).count() == 0


def test_blocked_join_equals_naive(spark, small):
    slugs = views.view(spark, small, views.SLUGS)
    rounded = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    want = rounded(similarity.naive_pairs(slugs, 0.4))
    for blocks in (4, 9):
        assert want and rounded(similarity.near_duplicate_pairs(slugs, 0.4, blocks=blocks)) == want


def test_link_suggestions(spark):
    a = articles(spark, c__a=[1, 0, 0], c__b=[0.99, 0.01, 0], c__c=[0, 1, 0], cat=[1, 0, 0])
    got = {(r.source_slug, r.target_slug) for r in similarity.link_suggestions(a, blocks=2).collect()}
    # A bare slug is a target only; dissimilar ones are left out.
    assert got == {("c/a", "c/b"), ("c/b", "c/a"), ("c/a", "cat"), ("c/b", "cat")}
    linked = spark.createDataFrame([("c/a", "c/b")], "source_slug string, target_slug string")
    assert ("c/a", "c/b") not in {(r.source_slug, r.target_slug) for r in similarity.link_suggestions(a, linked, blocks=1).collect()}


def test_cut_comes_before_links_are_taken_away(spark):
    a = articles(spark, c__s=[1, 0], **{f"c__t{k}": [1, 0.01 * k] for k in range(1, 8)})
    top = [r.target_slug for r in similarity.top_similar(a.filter("slug <> 'x'"), 5, 2).filter("source_slug = 'c/s'").orderBy("rank").collect()]
    assert top == [f"c/t{k}" for k in range(1, 6)]
    linked = spark.createDataFrame([("c/s", "c/t1")], "source_slug string, target_slug string")
    assert similarity.link_suggestions(a, linked, blocks=2).filter("source_slug = 'c/s'").count() == 4


def test_near_equal_targets_go_by_slug(spark):
    """Forty targets whose products differ by less than the rounding: the smallest slugs win."""
    near = {f"c__t{k:02}": [1, 1e-7 * (40 - k)] for k in range(40)}
    a = spark.createDataFrame([(k.replace("__", "/"), [float(x) for x in v]) for k, v in {"c__s": [1, 0], **near}.items()], "slug string, embedding array<double>")
    for blocks in (1, 2, 9):
        top = [r.target_slug for r in similarity.top_similar(a, 5, blocks).filter("source_slug = 'c/s'").orderBy("rank").collect()]
        assert top == [f"c/t{k:02}" for k in range(5)]


def test_refresh(spark):
    now = dt.datetime(2026, 7, 2)
    texts = spark.createDataFrame([("a", "u/a", "same"), ("b", "u/b", "new text"), ("c", "u/c", "fresh"), ("e", "u/e", None)], "slug string, url string, text string")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    old = dt.datetime(2026, 7, 1)
    known = spark.createDataFrame([("a", "old/a", h("same"), [1.0], old), ("b", "old/b", h("old"), [1.0], old), ("d", "old/d", h("d"), [1.0], old), ("e", "old/e", h("e"), [1.0], old)], schemas.ARTICLE)
    changes = {r.slug: r.action for r in similarity.change_set(texts.filter("text is not null"), known).collect()}
    assert changes == {"a": "unchanged", "b": "changed", "c": "new"}
    got = {r.slug: r for r in similarity.refresh_embeddings(texts, known, similarity.hashing_embedder(16), now).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert got["b"].url == "old/b" and got["b"].updated_at == now and abs(np.linalg.norm(got["b"].embedding) - 1) < 1e-5
    assert got["a"].updated_at == old and got["d"].embedding == [1.0] and got["c"].url == "u/c" and got["e"].content_hash == h("e")


def test_link_key_differs_from_the_finding_key(spark):
    import hashlib

    from pyspark.sql import functions as F

    assert spark.range(1).select(link_key(F.lit("a"), F.lit("b"))).first()[0] == hashlib.sha256(b"internalLinking:a:b").hexdigest()


def test_templates(spark):
    rows = [("1", 0, "slow", 40), ("2", 1, "slow", 42), ("3", 2, "slow", 38), ("4", 0, "once", 10), ("5", 0, "mixed", 40), ("6", 1, "mixed", 90), ("7", 2, "mixed", 20), ("8", 3, "slow", None)]
    a = spark.createDataFrame(rows, "id string, run_no int, url string, performance_score int")
    history = architecture.template_history(a, order="run_no")
    assert {r.url: r.scores for r in history.collect()} == {"slow": [40, 42, 38], "mixed": [40, 90, 20]}
    assert [r.url for r in architecture.slow_templates(history).collect()] == ["slow"]


def test_missing_templates(spark):
    as_of = dt.date(2026, 7, 1)
    snap = spark.createDataFrame([(as_of, "p", "fotografo boda Malaga", 1, 600, 1.0), (as_of, "p", "boda sevilla", 1, 900, 1.0), (as_of, "p", "accesorias", 1, 700, 1.0), (as_of - dt.timedelta(91), "p", "huesca", 1, 900, 1.0)], "date date, page string, query string, clicks int, impressions int, position double")
    slugs = spark.createDataFrame([("bodas-sevilla-guia",)], "slug string")
    terms = spark.createDataFrame([(t,) for t in ("malaga", "sevilla", "soria", "huesca")], "term string")
    got = {r.term: r.impressions for r in architecture.missing_templates(snap, slugs, terms, as_of).collect()}
    assert got == {"malaga": 600, "soria": 700}  # terms are looked for as parts of text
    assert {r.term for r in architecture.missing_templates(snap, slugs, terms, as_of, by_word=True).collect()} == {"malaga"}
    pairs = spark.createDataFrame([("a", "b", 0.95)], "slug_a string, slug_b string, similarity double")
    history = spark.createDataFrame([("u", [1, 2, 3])], "url string, scores array<int>")
    found = architecture.architecture_findings(history, pairs, architecture.missing_templates(snap, slugs, terms, as_of)).collect()
    assert len(found) == 4 and {r.source for r in found} == {"siteArchitecture"}


def test_registered_terms_are_parts(spark, small):
    assert {r.term for r in queries.term_gap(spark, small).collect()} <= set(queries.TERMS)


def clustered(spark, n=400, groups=12, dims=24, spread=0.05):
    """Tight groups of vectors, as articles on one subject are."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(groups, dims))
    rows = [(f"c{k % groups}/v{k:03}" if k % 9 else f"v{k:03}", (centers[k % groups] + spread * rng.normal(size=dims) * np.linalg.norm(centers[k % groups])).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "slug string, embedding array<double>")


def test_far_blocks_are_never_met(spark):
    """The same pairs as pair by pair, from a fraction of the products."""
    a = clustered(spark)
    rounded = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    want = rounded(similarity.naive_pairs(a, 0.92))
    assert len(want) > 500 and rounded(similarity.near_duplicate_pairs(a, blocks=12)) == want
    done = similarity.products(similarity.dealt_pairs(a, 0.92, 12)).first().products
    assert len(want) <= done < 0.25 * 400 * 399 / 2


def test_far_blocks_are_not_searched(spark):
    a = clustered(spark)
    units = {r.slug: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in a.collect()}
    for floor in (-2.0, 0.35):
        got = {}
        for r in similarity.top_similar(a, 5, 12, floor).collect():
            got.setdefault(r.source_slug, []).append((r.rank, r.target_slug))
        want = {}
        for s, u in units.items():
            if "/" in s:
                best = sorted((-round(float(u @ w), 9), t) for t, w in units.items() if t != s and u @ w >= floor)[:5]
                want[s] = [(n + 1, t) for n, (_, t) in enumerate(best)]
        assert {s: sorted(x) for s, x in got.items()} == want
    _, both = similarity.dealt_sources(a, 5, 0.35, 400, 12)
    sides = both.withColumn("mine", (F.col("i") == F.col("block")).cast("int")).groupBy("i", "j").agg(F.sum("mine").alias("s"), F.count("*").alias("n"))
    assert sum(r.s * (r.n - r.s) for r in sides.collect()) < 0.5 * 400 * 399


def test_many_equal_vectors_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    a = spark.createDataFrame([(f"c/{k:02}", [1.0, 2.0]) for k in range(30)] + [("c/x", [2.0, -1.0])], "slug string, embedding array<double>")
    dealt = similarity.dealt_pairs(a, 0.92, 8)
    assert dealt.groupBy("i", "j", "block").count().agg({"count": "max"}).first()[0] < 30
    assert similarity.near_duplicate_pairs(a, blocks=8).count() == 30 * 29 // 2
    assert [r.target_slug for r in similarity.top_similar(a, 3, 8).filter("source_slug = 'c/07'").orderBy("rank").collect()] == ["c/00", "c/01", "c/02"]


def test_many_terms_in_one_pass(spark):
    """The same rows as a test of each pair, for a long list with terms in terms."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abñ") for _ in range(rng.randint(1, 4)))
    terms = sorted({word() for _ in range(80)})
    queries_ = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)]
    as_of = dt.date(2026, 7, 1)
    snap = spark.createDataFrame([(as_of, "p", q, 1, 10 + n, 1.0) for n, q in enumerate(queries_)], "date date, page string, query string, clicks int, impressions int, position double")
    listed = spark.createDataFrame([(t,) for t in terms] + [(None,), ("",), (terms[0],)], "term string")
    got = {(r.q, r.term) for r in architecture.term_matches(snap, listed).collect()}
    assert got == {(q, t) for q in queries_ for t in terms if t in q}
    alone = {(r.q, r.term) for r in architecture.term_matches(snap, listed, True).collect()}
    import re

    assert alone == {(q, t) for q in queries_ for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", q)}
    many = spark.createDataFrame([(f"term {n}",) for n in range(50_000)], "term string")
    assert {r.term for r in architecture.term_matches(snap.withColumn("query", F.lit("x term 4177 y")), many).collect()} == {"term 4", "term 41", "term 417", "term 4177"}


def test_known_articles_without_news_are_not_shuffled(spark):
    """Of 20,000 known articles only those in the buckets of 50 new ones are joined."""
    known = spark.range(20_000).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("slug"), F.lit("h").alias("content_hash"))
    news = spark.range(19_975, 20_025).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("slug"), F.lit("text").alias("text"))
    left = similarity.with_slugs_of(known, news)
    assert 25 <= left.count() < 100
    assert {r.slug for r in left.collect()} >= {f"a/{n}" for n in range(19_975, 20_000)}
    actions = similarity.change_set(news, known).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in actions} == {"changed": 25, "new": 25}
    plan = similarity.change_set(news, known)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastExchange" in plan
    assert similarity.with_slugs_of(known, news.filter("false")).count() == 0


def test_single_precision_only_leaves_out(spark):
    """F3-F10, F13, F14: products closer than single precision tells apart are ranked
    and cut by double precision, over several tiles, and rows without a slug match nothing."""
    vectors = {f"c/t{k:03}": [1.0, 1e-3 + 1e-8 * ((k * 37) % 101)] for k in range(101)}
    a = spark.createDataFrame([("c/s", [1.0, 0.0]), (None, [1.0, 0.0]), *vectors.items()], "slug string, embedding array<double>")
    near = sorted((v[1], k) for k, v in vectors.items())
    for blocks in (1, 3, 9):
        top = similarity.top_similar(a, 5, blocks).filter("source_slug = 'c/s'").orderBy("rank").collect()
        order = sorted((-round(1e9 / np.hypot(1.0, y)), t) for y, t in near)
        assert [r.target_slug for r in top] == [t for _, t in order[:5]]
    least = 1.0 / np.hypot(1.0, near[50][0] + 5e-9)
    got = {r.slug_b for r in similarity.near_duplicate_pairs(a, least, blocks=1).filter("slug_a = 'c/s'").collect()}
    assert got == {t for _, t in near[:51]}


def test_blocks_follow_cores_and_the_length_is_summed_up_once(spark):
    a = spark.range(10_000).select(F.concat(F.lit("c/"), "id").alias("slug"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert similarity._layout(a)[1] <= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = similarity._units(a)._jdf.queryExecution().analyzed().toString()
    assert "zip_with" in plan and "transform(" not in plan


def test_embedder_holds_words_of_few_texts(spark):
    """eight times the texts of a batch do not take eight times the memory."""
    import tracemalloc

    import pandas as pd

    def peak(n):
        texts = pd.Series([" ".join(f"w{k % 97}" for k in range(m, m + 250)) for m in range(n)] + [None])
        tracemalloc.start()
        out = similarity.hashing_embedder(8).func(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n + 1 and abs(np.linalg.norm(out[0]) - 1) < 1e-5 and not np.any(out[n])
        return most

    assert peak(8000) < 3 * peak(1000)
