import datetime as dt

from siteledger import schemas
from siteledger.operators import findings, ledger

T0, T1, T2 = dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 2), dt.datetime(2026, 7, 3)


def found(spark, *keys, source="robots", kind="robots-other"):
    return findings.scored(spark.createDataFrame([(source, kind, k, k, k, "r") for k in keys] or [], schemas.FINDING))


def states(df):
    return {r.title: (r.status, r.action) for r in df.collect()}


def test_life_of_an_opportunity(spark):
    one = ledger.first_ledger(found(spark, "a", "b"), T0).cache()
    assert one.filter("status = 'open'").count() == 2
    two = ledger.sync_opportunities(one, found(spark, "a", "c"), T1).cache()
    assert states(two) == {"a": ("open", "updated"), "b": ("resolved", "resolved"), "c": ("open", "created")}
    assert ledger.action_counts(two).first().asDict() == {"created": 1, "reopened": 0, "updated": 1, "resolved": 1}
    three = ledger.sync_opportunities(two.drop("action"), found(spark, "b"), T2).cache()
    assert states(three) == {"a": ("resolved", "resolved"), "b": ("open", "reopened"), "c": ("resolved", "resolved")}
    b = three.filter("title = 'b'").first()
    assert b.resolved_at is None and b.first_detected_at == T0


def test_second_run_changes_nothing(spark):
    one = ledger.first_ledger(found(spark, "a", "b"), T0).cache()
    two = ledger.sync_opportunities(one, found(spark, "a", "b"), T1)
    assert {r.action for r in two.collect()} == {"updated"}
    assert sorted(map(tuple, two.drop("action").collect())) == sorted(map(tuple, one.collect()))


def test_only_sources_in_scope_are_resolved(spark):
    one = ledger.first_ledger(found(spark, "a").unionByName(found(spark, "m", source="siteArchitecture", kind="site-architecture-missing-template")), T0).cache()
    none = found(spark, "a").filter("false")
    kept = states(ledger.sync_opportunities(one, none, T1, scope=["robots"]))
    assert kept == {"a": ("resolved", "resolved"), "m": ("open", "kept")}
    assert states(ledger.sync_opportunities(one, none, T1)) == {"a": ("resolved", "resolved"), "m": ("resolved", "resolved")}


def test_suggestions(spark):
    old = spark.createDataFrame([("1", "s", "a", 0.5, "open"), ("2", "s", "b", 0.5, "open"), ("3", "s", "c", 0.5, "dismissed")], schemas.LINK_SUGGESTION)
    new = spark.createDataFrame([("1", "s", "a", 0.6), ("3", "s", "c", 0.7), ("4", "s", "d", 0.8)], "stable_key string, source_slug string, target_slug string, similarity double")
    got = {r.stable_key: (r.status, r.action, r.similarity) for r in ledger.sync_suggestions(old, new).collect()}
    assert got == {"1": ("open", "updated", 0.6), "2": ("dismissed", "dismissed", 0.5), "3": ("dismissed", "updated", 0.7), "4": ("open", "created", 0.8)}


def test_upsert_takes_the_last_arrival_and_keeps_columns(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, u string")
    new = spark.createDataFrame([("a", 5, "new", 1), ("a", 9, "new", 2), ("c", 3, "z", 1)], "k string, n int, u string, at int")
    got = ledger.upsert(old, new.drop("at"), ["k"], arrival=F.col("n"))
    assert sorted(map(tuple, got.collect())) == [("a", 9, "new"), ("b", 2, "y"), ("c", 3, "z")]
    got = ledger.upsert(old, new.filter("n <> 5").drop("at"), ["k"], keep=["u"])
    assert sorted(map(tuple, got.select("k", "n", "u").collect())) == [("a", 9, "x"), ("b", 2, "y"), ("c", 3, "z")]


def test_reviews(spark):
    f = spark.createDataFrame([("internalLinking", "internal-link-suggestion", k, k, '{"sourceSlug":"s"}', "r") for k in "abc"], schemas.FINDING)
    one = ledger.first_ledger(findings.scored(f), T0).cache()
    key = {r.title: r.stable_key for r in one.collect()}
    reviews = spark.createDataFrame([(key["a"], "rejected", "no room"), (key["b"], "applied", None)], "stable_key string, verdict string, reason string")
    articles = spark.createDataFrame([("s", "h1")], "slug string, content_hash string")
    got = {r.title: (r.status, r.reviewed_content_hash, r.review_reason) for r in ledger.record_reviews(one, reviews, articles, T1).collect()}
    assert got == {"a": ("open", "h1", "no room"), "b": ("resolved", None, None), "c": ("open", None, None)}
