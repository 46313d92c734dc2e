"""Registered queries: each applies operators to whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.rules import region_terms
from siteledger.functions.scalars import content_hash, stable_key
from siteledger.operators import architecture, changes, documents, findings, impact, ledger, metrics, reporting, similarity
from siteledger.plans import records, runs, streams
from siteledger.sources import landing
from siteledger.sources import views as v
from siteledger.sources.shared import kept
from siteledger.sources.views import AS_OF, BASE, LEDGER_AS_OF, table, view

NOW, LEDGER_NOW = dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 23)
CHANGES_AS_OF = dt.date(2002, 1, 31)
NEAR = 0.40
TERMS = ["q1", "q2", "q3", "q9", "q24", "v7", "1", "24", "q77"]


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, v.SEARCH_SNAPSHOT)


def _content(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    return findings.scored(findings.current_findings(as_of, snapshot=snapshot.filter(F.col("date") <= F.lit(as_of))))


def content_declining(spark: SparkSession, d: str) -> DataFrame:
    snap = _snapshot(spark, d)
    pages = metrics.declining_pages(snap, AS_OF).withColumn("stable_key", stable_key(F.lit("content"), F.concat(F.lit("content-declining:"), "page")))
    scored = findings.scored(metrics.declining_findings(snap, AS_OF)).select("stable_key", "priority_score")
    return pages.join(scored, "stable_key").select("page", "prior_clicks", "recent_clicks", F.round("decline", 6).alias("decline"), "stable_key", F.round("priority_score", 6).alias("priority_score"))


def content_cannibalization(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.competing_pages(_snapshot(spark, d), AS_OF)
    return rows.select("query", F.size("pages").alias("n_pages"), F.array_join("pages", ",").alias("pages"), stable_key(F.lit("content"), F.concat(F.lit("content-cannibalization:"), "query")).alias("stable_key"))


def content_query_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.query_gaps(_snapshot(spark, d), AS_OF)
    return rows.select("page", "query", "date", "clicks", "impressions", "position", stable_key(F.lit("content"), F.concat_ws(":", F.lit("content-query-gap"), "page", "query")).alias("stable_key"))


def term_gap(spark: SparkSession, d: str) -> DataFrame:
    return architecture.missing_templates(_snapshot(spark, d), view(spark, d, v.SLUGS), region_terms(spark, TERMS), AS_OF)


def scored_findings(spark: SparkSession, d: str) -> DataFrame:
    return _content(_snapshot(spark, d), AS_OF).select("source", "finding_type", "stable_key", "impact", "effort", "tier", F.round("priority_score", 6).alias("priority_score"))


def priority_by_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = _content(_snapshot(spark, d), AS_OF)
    return rows.groupBy("tier", "finding_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("priority_score"), 6).alias("priority"))


def _sync(spark: SparkSession, d: str) -> DataFrame:
    snap = _snapshot(spark, d)
    old = ledger.first_ledger(_content(snap, LEDGER_AS_OF), LEDGER_NOW)
    return ledger.sync_opportunities(old, _content(snap, AS_OF), NOW)


def opportunity_sync(spark: SparkSession, d: str) -> DataFrame:
    return _sync(spark, d).select("stable_key", "finding_type", "status", "action", "first_detected_at", "resolved_at")


def opportunity_sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.action_counts(_sync(spark, d))


def open_by_source(spark: SparkSession, d: str) -> DataFrame:
    return reporting.open_by_source(_sync(spark, d))


def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    snap = _snapshot(spark, d).select("date", "page", "query", "clicks", "impressions")
    old = snap.filter(F.col("date") <= F.lit(dt.date(2024, 1, 20)))
    late = landing.collection_window(snap, dt.date(2024, 1, 21)).withColumn("clicks", F.col("clicks") + 1)
    return ledger.upsert(old, late, ["date", "page", "query"])


def search_collection(spark: SparkSession, d: str) -> DataFrame:
    """Rows packed as API responses, a response a page, and read back."""
    keys = F.array(F.col("date").cast("string"), F.col("page"), F.col("query"))
    row = F.struct(keys.alias("keys"), F.col("clicks").cast("double").alias("clicks"), F.col("impressions").cast("double").alias("impressions"), F.lit(None).cast("double").alias("ctr"), F.col("position").alias("position"))
    responses = _snapshot(spark, d).groupBy("page", "date").agg(F.collect_list(row).alias("rows"))
    return landing.collection_window(landing.search_rows(responses), AS_OF)


def traffic_collection(spark: SparkSession, d: str) -> DataFrame:
    value = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    rows = view(spark, d, v.TRAFFIC_SNAPSHOT).withColumn("day", F.date_format("date", "yyyyMMdd"))
    row = F.struct(F.array(value("day"), value("page"), value("channel")).alias("dimensionValues"), F.array(value("sessions"), value("engaged_sessions"), value("conversions")).alias("metricValues"))
    return landing.traffic_rows(rows.groupBy("page", "date").agg(F.collect_list(row).alias("rows")))


def latest_batch(spark: SparkSession, d: str) -> DataFrame:
    return findings.latest_batch(_snapshot(spark, d), "date").select("date", "page", "query", "clicks")


def page_speed_audit(spark: SparkSession, d: str) -> DataFrame:
    parts = view(spark, d, v.PERFORMANCE_AUDIT)
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    body = F.format_string(
        '{"lighthouseResult":{"categories":{"performance":{"score":%s}},"audits":{"largest-contentful-paint":{"numericValue":%s},"cumulative-layout-shift":{"numericValue":%s}}},"loadingExperience":{"metrics":{"INTERACTION_TO_NEXT_PAINT":{"percentile":%s}}}}',
        number((F.col("performance_score") / 100)), number(F.col("lcp") * 1000), number(F.col("cls")), number(F.col("inp")),
    )
    failed = F.col("run_no") == 3
    reports = parts.select(F.col("id").alias("url"), F.when(~failed, body).alias("body"), F.when(failed, F.lit("status 500")).alias("fetch_error"))
    out = landing.page_speed(reports)
    return out.select("url", "performance_score", *[F.round(c, 6).alias(c) for c in ("lcp", "cls", "inp")], F.array_join("errors", "|").alias("errors"))


def performance_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.performance_findings(view(spark, d, v.PERFORMANCE_AUDIT))
    return rows.select("finding_type", F.col("source_ref_id").alias("id"), stable_key("source", "stable_key_input").alias("stable_key"))


def template_performance(spark: SparkSession, d: str) -> DataFrame:
    rows = architecture.slow_templates(architecture.template_history(view(spark, d, v.PERFORMANCE_AUDIT), order="run_no"))
    return rows.select("url", F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.near_duplicate_pairs(view(spark, d, v.SLUGS), NEAR).withColumn("similarity", F.round("similarity", 6))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """At the production threshold. The test vectors have no such pair, so each
    vector has a twin, turned a little: by more than the threshold for one in three."""
    slugs = view(spark, d, v.SLUGS)
    by = F.when(F.col("vec_id") % 3 == 0, 0.6).otherwise(0.2)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    turned = F.transform("embedding", lambda x, n: x.cast("double") + F.when(n == F.col("vec_id") % 8, by * norm).otherwise(0.0))
    twins = slugs.select(F.concat(F.lit("twin/"), "slug").alias("slug"), "vec_id", turned.alias("embedding"))
    both = slugs.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))).unionByName(twins)
    return similarity.near_duplicate_pairs(both).withColumn("similarity", F.round("similarity", 6))


def _third_linked(pairs: DataFrame) -> DataFrame:
    number = lambda c: F.regexp_extract(c, "v([0-9]+)$", 1).cast("long")
    return pairs.filter((number("source_slug") + number("target_slug")) % 3 == 0).select("source_slug", "target_slug")


def link_suggestions(spark: SparkSession, d: str) -> DataFrame:
    pairs = kept(similarity.top_similar(view(spark, d, v.SLUGS), at_least=similarity.FLOOR), "top-pairs")
    found = similarity.suggestions(pairs, _third_linked(pairs))
    return found.withColumn("similarity", F.round("similarity", 6))


def suggestion_sync(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions as if a third of them had been made already, and another third
    of those were not suggested any more."""
    new = kept(similarity.link_suggestions(view(spark, d, v.SLUGS)), "suggestions")
    n = F.regexp_extract("target_slug", "v([0-9]+)$", 1).cast("long") % 3
    old = new.filter(n < 2).withColumn("status", F.lit("open"))
    return ledger.sync_suggestions(old, new.filter(n > 0)).select("stable_key", "source_slug", "target_slug", "status", "action")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    due = impact.measurable(view(spark, d, v.APPLIED_CHANGE), CHANGES_AS_OF)
    return impact.measure(due, view(spark, d, v.DAILY_CLICKS))


def impact_measurement(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d)


def impact_by_page(spark: SparkSession, d: str) -> DataFrame:
    due = impact.measurable(view(spark, d, v.APPLIED_CHANGE), CHANGES_AS_OF)
    return impact.page_sums(due, view(spark, d, v.DAILY_CLICKS)).select(F.col("id").alias("change_id"), "page", "before", "after")


def graduation_streaks(spark: SparkSession, d: str) -> DataFrame:
    return impact.graduation_steps(_measured(spark, d)).select("change_id", "finding_type", "good", "eligible", F.coalesce("event", F.lit("")).alias("event"))


def graduation_records(spark: SparkSession, d: str) -> DataFrame:
    return impact.graduation_records(impact.graduation_steps(_measured(spark, d)))


def graduation_alerts(spark: SparkSession, d: str) -> DataFrame:
    return impact.impact_actions(impact.graduation_steps(_measured(spark, d)), view(spark, d, v.APPLIED_CHANGE)).select("change_id", "finding_type", "kind")


def tier1_plan(spark: SparkSession, d: str) -> DataFrame:
    ready = view(spark, d, v.TIER_CHANGES).filter("status = 'merged'").select("finding_type").distinct().select("finding_type", F.lit(10).cast("long").alias("consecutive_good"), F.lit(True).alias("auto_merge_eligible"))
    return changes.tier1_plan(view(spark, d, v.TIER_LEDGER), view(spark, d, v.TIER_CHANGES), ready, cap=None).select("stable_key", "finding_type", "action", "auto_merge")


def change_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, v.APPLIED_CHANGE).select("id", "finding_type", "status", F.col("id").alias("pr_number"))
    return changes.sync_changes(rows, view(spark, d, v.CHANGE_STATUS)).select("id", "status")


def briefing_rows(spark: SparkSession, d: str) -> DataFrame:
    """Link suggestions as ledger rows; of three in four sources the verdict was
    no: for the text of today, for another text, and never."""
    articles = view(spark, d, v.ARTICLES)
    hashed = articles.select("slug", "text", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "vec_id")
    made = similarity.link_suggestions(articles).withColumn("status", F.lit("open"))
    rows = ledger.first_ledger(findings.scored(findings.internal_link_findings(made)), NOW)
    n = F.regexp_extract(F.get_json_object("detail", "$.sourceSlug"), "v([0-9]+)$", 1).cast("long") % 4
    own = hashed.select(F.col("slug").alias("__s"), F.col("content_hash").alias("__h"))
    rows = rows.withColumn("__n", n).join(own, F.get_json_object("detail", "$.sourceSlug") == F.col("__s"), "left")
    rows = rows.withColumn("reviewed_content_hash", F.when(F.col("__n") == 0, F.col("__h")).when(F.col("__n") == 1, F.lit("other"))).drop("__n", "__s", "__h")
    out = reporting.briefing_rows(rows, hashed)
    return out.select("stable_key", "finding_type", "priority_score", "malformed", "source_slug", "target_slug", F.length("source_text").alias("source_chars"), F.length("target_text").alias("target_chars"))


def embedding_change_set(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), "text", (F.col("doc_id") % 3).alias("n"))
    known = docs.filter("n < 2").select("slug", F.when(F.col("n") == 0, content_hash("text")).otherwise("old").alias("content_hash"))
    return similarity.change_set(docs.select("slug", "text"), known)


def embedding_refresh(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.concat(F.lit(f"{BASE}/blog/"), F.col("doc_id").cast("string")).alias("url"), "text", (F.col("doc_id") % 3).alias("n"))
    known = docs.filter("n < 2").select("slug", F.lit("was").alias("url"), F.when(F.col("n") == 0, content_hash("text")).otherwise("old").alias("content_hash"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(LEDGER_NOW).cast("timestamp").alias("updated_at"))
    out = similarity.refresh_embeddings(docs.select("slug", "url", "text"), known, similarity.hashing_embedder(), NOW)
    return out.select("slug", "url", "content_hash", F.size("embedding").alias("dims"), "updated_at")


def workflow_health(spark: SparkSession, d: str) -> DataFrame:
    return reporting.workflow_health(view(spark, d, v.WORKFLOW_RUN), ["workflow", "run_on"])


def workflow_alerts(spark: SparkSession, d: str) -> DataFrame:
    latest = findings.latest_batch(view(spark, d, v.WORKFLOW_RUN), "run_on")
    return reporting.unread_alerts(reporting.workflow_alerts(reporting.workflow_health(latest), NOW)).select("type", "subject", "acknowledged")


def expiry_alerts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.expiry_alerts(view(spark, d, v.EXPIRATIONS), dt.datetime(1998, 8, 1, 13))


def last_changes(spark: SparkSession, d: str) -> DataFrame:
    return reporting.last_changes(view(spark, d, v.APPLIED_CHANGE)).select("id", "finding_type", "status", "merged_on")


def _extracted(spark: SparkSession, d: str, as_blog: bool = False) -> DataFrame:
    html = F.replace("html", F.lit('href="/'), F.lit('href="/blog/')) if as_blog else F.col("html")
    return documents.extract_pages(table(spark, d, "pages").select("url", html.alias("html"), F.lit(None).cast("string").alias("fetch_error")))


def article_text(spark: SparkSession, d: str) -> DataFrame:
    return documents.article_texts(_extracted(spark, d)).select("url", "text")


def existing_links(spark: SparkSession, d: str) -> DataFrame:
    return documents.linked_slugs(_extracted(spark, d, True))


def structured_data_audit(spark: SparkSession, d: str) -> DataFrame:
    return documents.audit_structured_data(_extracted(spark, d)).withColumn("errors", F.array_join("errors", "|"))


def structured_data_findings(spark: SparkSession, d: str) -> DataFrame:
    audit = documents.audit_structured_data(_extracted(spark, d)).withColumn("id", F.col("url"))
    return findings.structured_data_findings(audit).select("finding_type", stable_key("source", "stable_key_input").alias("stable_key"))


def robots_audit(spark: SparkSession, d: str) -> DataFrame:
    return documents.audit_robots(view(spark, d, v.ROBOTS_DOCUMENTS)).withColumn("errors", F.array_join("errors", "|"))


def robots_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.robots_findings(documents.audit_robots(view(spark, d, v.ROBOTS_DOCUMENTS)).withColumn("id", F.col("site")))
    return rows.select(F.col("source_ref_id").alias("site"), "finding_type", "stable_key_input")


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap for every hundred pages; every eighth one is cut short, every
    other eighth one could not be fetched."""
    pages = table(spark, d, "pages").withColumn("n", F.floor(F.col("page_id") / 100).cast("long"))
    loc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_add(F.lit(AS_OF), (-(F.col("page_id") % 800)).cast("int")).cast("string")
    url = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>"))
    sites = pages.groupBy("n").agg(F.array_join(F.collect_list(url), "").alias("urls"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.when(F.col("n") % 8 == 3, "").otherwise("</urlset>"))
    failed = F.col("n") % 8 == 5
    return sites.select(F.col("n").cast("string").alias("site"), F.lit("https://").alias("base_url"), F.when(~failed, body).alias("body"), F.when(failed, "status 404").alias("fetch_error"))


def sitemap_audit(spark: SparkSession, d: str) -> DataFrame:
    return documents.audit_sitemaps(_sitemaps(spark, d), NOW).select("site", "url_count", "stale_entries", F.size("errors").alias("n_errors"), F.element_at("errors", 1).alias("first_error")).fillna("", ["first_error"])


def sitemap_findings(spark: SparkSession, d: str) -> DataFrame:
    audit = documents.audit_sitemaps(_sitemaps(spark, d), NOW).withColumn("id", F.col("site"))
    return findings.sitemap_findings(audit).groupBy("source_ref_id", "finding_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stable_key_input").alias("n_keys"))


def published_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of sitemaps whose addresses were moved under one site's /blog/."""
    whole = _sitemaps(spark, d).filter(F.contains("body", F.lit("</urlset>")))
    moved = whole.withColumn("body", F.regexp_replace("body", "<loc>https?://[^/<]*/", f"<loc>{BASE}/blog/"))
    return documents.published_articles(moved, BASE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    content_declining, content_cannibalization, content_query_gap, term_gap, scored_findings, priority_by_tier, opportunity_sync, opportunity_sync_counts, open_by_source,
    snapshot_upsert, search_collection, traffic_collection, latest_batch, page_speed_audit, performance_findings, template_performance, near_duplicate_pairs, near_duplicates, link_suggestions,
    suggestion_sync, impact_measurement, impact_by_page, graduation_streaks, graduation_records, graduation_alerts, tier1_plan, change_sync, briefing_rows, embedding_change_set,
    embedding_refresh, workflow_health, workflow_alerts, expiry_alerts, last_changes, article_text, existing_links, structured_data_audit, structured_data_findings,
    robots_audit, robots_findings, sitemap_audit, sitemap_findings, published_articles,
)}
QUERIES |= runs.QUERIES | streams.QUERIES | records.QUERIES
