"""Further registered queries: whole runs, texts of findings and alerts, counters.

Cases that the shared tables lack (JSON-LD, reviews, region names) are derived
from their rows, in the same way in `runs_sql`."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.rules import REGION_TERMS, region_terms
from siteledger.functions.scalars import content_hash, stable_key
from siteledger.operators import architecture, changes, documents, findings, impact, ledger, reporting, similarity
from siteledger.sources import landing
from siteledger.sources import views as v
from siteledger.sources.shared import kept
from siteledger.sources.views import AS_OF, BASE, LEDGER_AS_OF, table, view

NOW, LATER = dt.datetime(2024, 1, 30), dt.datetime(2024, 2, 6)
CHANGES_AS_OF, HALF = dt.date(2002, 1, 31), dt.date(1998, 1, 1)
NEAR = 0.40


def _content(spark: SparkSession, d: str, as_of: dt.date) -> DataFrame:
    snap = view(spark, d, v.SEARCH_SNAPSHOT)
    return findings.current_findings(as_of, snapshot=snap.filter(F.col("date") <= F.lit(as_of)))


def _json_ld(spark: SparkSession, d: str) -> DataFrame:
    """Audited pages with JSON-LD put before them: objects, arrays, bad and missing ones."""
    script = lambda body: F.lit(f'<script type="application/ld+json">{body}</script>')
    n = F.col("page_id") % 8
    block = (
        F.when(n == 1, script('{"@type":"Article","headline":"h","author":"a","datePublished":"2024-01-01"}'))
        .when(n == 2, script('{"@type":"Article","author":"","datePublished":"2024-01-01"}'))
        .when(n == 3, script('[{"@type":"Organization","name":"n"},{"@type":"WebSite","name":"n","url":"u"},7]'))
        .when(n == 4, script('{"@type":"Article",'))
        .when(n == 5, script('{"@type":"Thing"}'))
        .when(n == 7, F.concat(script('{"@type":"DefinedTermSet","name":null}'), script('{"@type":"Dataset","name":"x","description":5}')))
        .otherwise("")
    )
    pages = table(spark, d, "pages").select("url", F.concat(block, "html").alias("html"), F.when(n == 6, "status 500").alias("fetch_error"))
    return documents.audit_structured_data(documents.extract_pages(pages))


def json_ld_audit(spark: SparkSession, d: str) -> DataFrame:
    return _json_ld(spark, d).withColumn("errors", F.array_join("errors", "|"))


def json_ld_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.structured_data_findings(_json_ld(spark, d).withColumn("id", F.col("url")))
    return rows.select("finding_type", stable_key("source", "stable_key_input").alias("stable_key"), "title", "detail")


def finding_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of what the finders over search metrics, page speed and robots files find."""
    robots = findings.robots_findings(documents.audit_robots(view(spark, d, v.ROBOTS_DOCUMENTS)).withColumn("id", F.col("site")))
    speed = findings.performance_findings(view(spark, d, v.PERFORMANCE_AUDIT))
    rows = findings.union(_content(spark, d, AS_OF), robots, speed)
    return rows.select("source", "finding_type", "stable_key_input", "title", "source_ref_id")


def other_findings(spark: SparkSession, d: str) -> DataFrame:
    """Messages that no rule names."""
    audits = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(F.concat(F.lit("odd "), "source")).alias("errors"), F.lit(0).alias("stale_entries"))
    rows = findings.union(findings.sitemap_findings(audits), findings.robots_findings(audits))
    return rows.select("source", "finding_type", "stable_key_input", "title", "detail", "source_ref_id")


def daily_findings(spark: SparkSession, d: str) -> DataFrame:
    """The daily run over all six sources: newest row or batch of each."""
    sites = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 40).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    at = lambda days: F.to_timestamp(F.date_add(F.lit(AS_OF), (-days).cast("int")))
    sitemap = sites.select(F.col("n").cast("string").alias("id"), at(F.col("n") % 5).alias("run_at"), F.col("c").cast("int").alias("url_count"), F.lit(4).alias("stale_entries"), F.array(F.concat(F.lit(findings.OUT_OF_DOMAIN), F.col("n").cast("string"))).alias("errors"))
    robots = documents.audit_robots(view(spark, d, v.ROBOTS_DOCUMENTS)).select(F.col("site").alias("id"), at((F.col("site").cast("long") + 2) % 7).alias("run_at"), "is_valid", "errors")
    pages = _json_ld(spark, d).select(F.col("url").alias("id"), at(F.length("url") % 3).alias("run_at"), "url", "schema_type", "is_valid", "errors")
    speed = view(spark, d, v.PERFORMANCE_AUDIT).withColumn("run_at", at(3 - F.col("run_no")))
    links = similarity.link_suggestions(view(spark, d, v.SLUGS)).withColumn("status", F.lit("open"))
    found = findings.current_findings(AS_OF, view(spark, d, v.SEARCH_SNAPSHOT), sitemap, robots, pages, speed, links)
    return findings.scored(found).select("source", "finding_type", "stable_key", "tier", F.round("priority_score", 6).alias("priority_score"))


def _three_runs(spark: SparkSession, d: str) -> DataFrame:
    old, new = (findings.scored(_content(spark, d, day)) for day in (LEDGER_AS_OF, AS_OF))
    second = ledger.sync_opportunities(ledger.first_ledger(old, dt.datetime(2024, 1, 23)), new, NOW).drop("action")
    return ledger.sync_opportunities(second, old, LATER)


def reopened_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A third run that finds what the first one found."""
    return _three_runs(spark, d).select("stable_key", "status", "action", "first_detected_at", "resolved_at")


def reopened_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.action_counts(_three_runs(spark, d))


def _architecture(spark: SparkSession, d: str) -> DataFrame:
    history = architecture.template_history(view(spark, d, v.PERFORMANCE_AUDIT), order="run_no")
    pairs = kept(similarity.near_duplicate_pairs(view(spark, d, v.SLUGS), NEAR), "near-pairs")
    return findings.scored(architecture.architecture_findings(history, pairs, _region_gap(spark, d)))


def architecture_sync(spark: SparkSession, d: str) -> DataFrame:
    """A run of one source: what it finds no more is resolved, other sources stay."""
    found = _architecture(spark, d)
    gone = F.ascii("stable_key") % 3 == 0
    both = ledger.first_ledger(found.unionByName(findings.scored(_content(spark, d, AS_OF))), NOW)
    out = ledger.sync_opportunities(both, found.filter(~gone), LATER, ["siteArchitecture"])
    return out.select("stable_key", "source", "finding_type", "title", "status", "action")


def _region_gap(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in REGION_TERMS])
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int")
    snap = view(spark, d, v.SEARCH_SNAPSHOT)
    place = (number("query") + 3 * number("page")) % len(REGION_TERMS)
    asked = snap.withColumn("query", F.concat(F.lit("Boda en "), F.initcap(F.get(names, place))))
    slugs = view(spark, d, v.SLUGS).filter("vec_id % 4 = 0").select(F.concat(F.lit("Bodas-"), F.get(names, (F.col("vec_id") % 12).cast("int"))).alias("slug"))
    return architecture.missing_templates(asked, slugs, region_terms(spark), AS_OF)


def region_term_gap(spark: SparkSession, d: str) -> DataFrame:
    """Searches for regions that no article is about."""
    return _region_gap(spark, d)


def closest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar pairs of articles, in order."""
    pairs = similarity.in_order(similarity.near_duplicate_pairs(view(spark, d, v.SLUGS), NEAR)).limit(10)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def _mixed_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, v.APPLIED_CHANGE)
    return rows.withColumn("finding_type", F.when(F.col("id") % 3 == 0, impact.LINK_TYPE).otherwise(F.col("finding_type")))


def link_impact(spark: SparkSession, d: str) -> DataFrame:
    """Link changes on the page that their ledger row names, others site-wide."""
    due = impact.measurable(_mixed_changes(spark, d), CHANGES_AS_OF)
    rows = table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("stable_key"), F.to_json(F.struct(F.concat(F.lit("p/"), (F.col("o_custkey") % 20).cast("string")).alias("sourceSlug"))).alias("detail"))
    daily = view(spark, d, v.DAILY_CLICKS).withColumn("page", F.replace("page", F.lit("/p/"), F.lit("/blog/p/")))
    return impact.measure(due, daily, rows, BASE)


def measurable_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes due that were not measured before, without one type."""
    rows = view(spark, d, v.APPLIED_CHANGE)
    done = rows.filter("id % 2 = 0").select(F.col("id").alias("change_id"))
    return impact.measurable(rows, CHANGES_AS_OF, done, ["type-3"]).select("id", "finding_type", "merged_on")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    due = impact.measurable(view(spark, d, v.APPLIED_CHANGE), CHANGES_AS_OF)
    return impact.measure(due, view(spark, d, v.DAILY_CLICKS))


def graduation_continued(spark: SparkSession, d: str) -> DataFrame:
    """Steps of later changes, from the records that earlier ones left."""
    rows = _measured(spark, d)
    early = rows.filter(F.col("merged_on") < F.lit(HALF))
    records = impact.graduation_records(impact.graduation_steps(early))
    steps = impact.graduation_steps(rows.filter(F.col("merged_on") >= F.lit(HALF)), records)
    return steps.select("change_id", "finding_type", "good", "eligible", F.coalesce("event", F.lit("")).alias("event"))


def impact_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, v.APPLIED_CHANGE).withColumn("pr_url", F.concat(F.lit("https://code.example/pr/"), F.col("id").cast("string")))
    return impact.alert_texts(impact.impact_actions(impact.graduation_steps(_measured(spark, d)), rows), rows)


def revert_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, v.APPLIED_CHANGE)
    return impact.revert_plan(impact.impact_actions(impact.graduation_steps(_measured(spark, d)), rows), rows)


def _capped(spark: SparkSession, d: str) -> DataFrame:
    """Three openings; one type has no fixer, and files differ by type."""
    targets = spark.createDataFrame([("robots-missing-sitemap-directive", "a", True), ("robots-blocks-all", "b", False)], "finding_type string, target_file string, has_fixer boolean")
    none = spark.createDataFrame([], "finding_type string, consecutive_good long, auto_merge_eligible boolean")
    return changes.tier1_plan(view(spark, d, v.TIER_LEDGER), view(spark, d, v.TIER_CHANGES), none, targets=targets)


def tier1_capped(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).select("stable_key", "finding_type", "action")


def tier1_counts(spark: SparkSession, d: str) -> DataFrame:
    return changes.plan_counts(_capped(spark, d))


def collection_failures(spark: SparkSession, d: str) -> DataFrame:
    reports = view(spark, d, v.PERFORMANCE_AUDIT).select(F.col("id").alias("url"), F.when(F.col("run_no") != 3, "{}").alias("body"), F.when(F.col("run_no") == 3, "status 500").alias("fetch_error"))
    return reporting.collection_counts(landing.page_speed(reports))


def _linked_ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles = view(spark, d, v.ARTICLES).select("slug", "text", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "embedding")
    made = kept(similarity.link_suggestions(articles), "suggestions").withColumn("status", F.lit("open"))
    return ledger.first_ledger(findings.scored(findings.internal_link_findings(made)), NOW), articles


def reviewed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on link suggestions: of every four sources one rejects, one applies."""
    rows, articles = _linked_ledger(spark, d)
    n = F.regexp_extract(F.get_json_object("detail", "$.sourceSlug"), "v([0-9]+)$", 1).cast("long") % 4
    reviews = rows.withColumn("n", n).filter("n < 2").select("stable_key", F.when(F.col("n") == 0, "rejected").otherwise("applied").alias("verdict"), F.lit("why").alias("reason"))
    out = ledger.record_reviews(rows, reviews, articles, LATER)
    return out.select("stable_key", "status", "resolved_at", "reviewed_at", "reviewed_content_hash", "review_reason")


def link_detail_check(spark: SparkSession, d: str) -> DataFrame:
    """Details of every kind: whole, of wrong types, with gaps, no JSON, none."""
    n, key = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    detail = (
        F.when(n == 0, text('{"sourceSlug":"s', key, '","targetSlug":"t","similarity":0.5}')).when(n == 1, text('{"sourceSlug":"s', key, '","targetSlug":7,"similarity":0.5}'))
        .when(n == 2, text('{"sourceSlug":"","targetSlug":"t","similarity":1}')).when(n == 3, text('{"sourceSlug":"s","targetSlug":"t","similarity":"0.5"}')).when(n == 4, text("{broken", key))
    )
    rows = table(spark, d, "orders").select(text("k", key).alias("stable_key"), detail.alias("detail"))
    return reporting.link_details(rows).select("stable_key", "source_slug", "target_slug", "similarity", "well_formed")


def embedding_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"), (F.col("doc_id") % 3).alias("n"))
    known = docs.filter("n < 2").select("slug", F.when(F.col("n") == 0, content_hash("text")).otherwise("old").alias("content_hash"))
    return similarity.refresh_counts(docs.select("slug", "text"), known)


def late_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Two corrections of a day in one batch: the one that arrived last wins, lower or not."""
    snap = view(spark, d, v.SEARCH_SNAPSHOT).select("date", "page", "query", "clicks", "impressions")
    late = landing.collection_window(snap, AS_OF)
    both = late.withColumn("clicks", F.col("clicks") + 9).withColumn("arrived", F.lit(1)).unionByName(late.withColumn("clicks", F.col("clicks") - 1).withColumn("arrived", F.lit(2)))
    return ledger.upsert(snap.withColumn("arrived", F.lit(0)), both, ["date", "page", "query"], F.col("arrived")).select(*snap.columns)


def health_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest status of each workflow, kept up by key, a batch a half of the month."""
    steps = view(spark, d, v.WORKFLOW_RUN)
    first, rest = (steps.filter(F.col("run_on") < F.lit(dt.date(2024, 1, 15))), steps.filter(F.col("run_on") >= F.lit(dt.date(2024, 1, 15))))
    newest = lambda df: reporting.workflow_health(df.join(df.groupBy("workflow").agg(F.max("run_on").alias("run_on")), ["workflow", "run_on"], "left_semi"), ["workflow", "run_on"])
    return ledger.upsert(newest(first), newest(rest), ["workflow"])


def open_priorities(spark: SparkSession, d: str) -> DataFrame:
    """The fifty open rows of the ledger that come first."""
    return reporting.open_by_priority(view(spark, d, v.TIER_LEDGER)).limit(50).select("stable_key", "finding_type", "priority_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    json_ld_audit, json_ld_findings, finding_titles, other_findings, daily_findings, reopened_ledger, reopened_counts, architecture_sync, region_term_gap, closest_pairs,
    link_impact, measurable_changes, graduation_continued, impact_alerts, revert_changes, tier1_capped, tier1_counts, collection_failures, reviewed_ledger,
    link_detail_check, embedding_counts, late_corrections, health_upsert, open_priorities,
)}
