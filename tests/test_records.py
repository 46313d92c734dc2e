from pyspark.sql import functions as F

from siteledger.functions.order import ranked
from siteledger.operators import changes, findings, reporting


def test_ranks_equal_a_sort(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id"))
    got = {r.id: r.rank for r in ranked(rows.repartition(6), [-F.col("x"), "id"]).collect()}
    order = sorted(range(500), key=lambda n: (-(n * 7919 % 1000), n))
    assert got == {n: k + 1 for k, n in enumerate(order)}
    assert ranked(rows.filter("false"), ["id"]).count() == 0


def test_errors_that_are_no_array_hold_no_message(spark):
    texts = [("1", '["robots.txt no declara ninguna directiva Sitemap:", "x"]'), ("2", '{"a": ["x"]}'), ("3", '"x"'), ("4", None), ("5", "no json"), ("6", "[broken"), ("7", "[]"), ("8", "17")]
    audits = spark.createDataFrame(texts, "id string, errors string")
    want = {("1", "robots-missing-sitemap-directive"), ("1", "robots-other")}
    shown = lambda df: {(r.source_ref_id, r.finding_type) for r in findings.robots_findings(df).collect()}
    assert shown(audits) == want
    assert shown(audits.withColumn("errors", F.try_parse_json("errors"))) == want
    assert shown(audits.withColumn("errors", F.lit(5))) == set()
    arrays = spark.createDataFrame([("1", ["x"]), ("2", None)], "id string, errors array<string>")
    assert shown(arrays) == {("1", "robots-other")}


def test_openings_and_reverts_become_changes(spark):
    known = spark.createDataFrame([("k0", "t", "merged", "f", "old")], "stable_key string, finding_type string, status string, file_path string, previous_content string")
    plan = spark.createDataFrame([("k1", "t", "f", "open", True), ("k2", "u", "g", "open", False), ("k3", "t", "f", "skippedDuplicate", False)], "stable_key string, finding_type string, target_file string, action string, auto_merge boolean")
    held = spark.createDataFrame([("f", "text of f")], "file_path string, content string")
    opened = changes.record_opened(known, plan, held)
    assert {tuple(r) for r in opened.collect()} == {("k0", "t", "merged", "f", "old"), ("k1", "t", "merged", "f", "text of f"), ("k2", "u", "open", "g", None)}
    reverts = spark.createDataFrame([("k0", "revert", "open", "f", "old", 7)], "stable_key string, finding_type string, status string, file_path string, new_content string, reverts_change_id long")
    assert ("k0", "revert", "open", "f", None) in {tuple(r) for r in changes.record_reverts(opened, reverts).collect()}


def test_sections_make_the_text(spark):
    rows = spark.createDataFrame([("b", "t", "B", 2.0, "r", False, None, None, None, None), ("a", "t", "A", 2.0, "r", True, None, None, None, None), ("c", "internal-link-suggestion", "C", 9.5, "r", False, "s", "t", "one", None)], "stable_key string, finding_type string, title string, priority_score double, source_ref_id string, malformed boolean, source_slug string, target_slug string, source_text string, target_text string")
    got = [r.section for r in reporting.briefing_sections(rows).orderBy("rank").collect()]
    text = reporting.briefing_text(rows).first().value
    assert got[0] + "\n".join(got[1:]) == text and "## C" in got[1] and "malformados" in got[2] and len(got) == 4
    none = reporting.briefing_sections(rows.filter("false")).collect()
    assert [r.section for r in none] == [reporting.briefing_text(rows.filter("false")).first().value]
