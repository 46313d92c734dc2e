"""Registered queries whose results are records: ranks, guarded messages, inserted
changes, appended audits and measurements; and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger import sinks
from siteledger.functions.order import ranked
from siteledger.functions.scalars import content_hash
from siteledger.operators import changes, findings, impact, ledger, reporting, similarity
from siteledger.plans.oracle import _IMPACT, _UNITS
from siteledger.plans.oracle import ORACLE_SQL as BATCH_SQL
from siteledger.sources import views as v
from siteledger.sources.shared import kept, new_folder
from siteledger.sources.views import view

NEAR = 0.40
NOW = dt.datetime(2024, 1, 30)
CHANGES_AS_OF = dt.date(2002, 1, 31)

#: Audits whose errors came as JSON texts: an array for one in four, else something that is none.
#: Braces are doubled for spark.sql.
JSON_AUDITS = """
SELECT CAST(p_partkey AS STRING) AS id, CAST(p_size % 2 AS INT) AS stale_entries,
       CASE p_partkey % 4 WHEN 0 THEN concat('["URL fuera de dominio en el sitemap: ', CAST(p_partkey AS STRING), '", "otro"]')
                          WHEN 1 THEN '{{"errors": ["otro"]}}' WHEN 2 THEN '"otro"' END AS errors
FROM part
"""


def guarded_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.sitemap_findings(view(spark, d, JSON_AUDITS))
    return rows.select("finding_type", "stable_key_input", F.col("source_ref_id").alias("id"))


def ranked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All similar pairs with their rank, the most similar first."""
    pairs = kept(similarity.near_duplicate_pairs(view(spark, d, v.SLUGS), NEAR), "near-pairs")
    out = ranked(pairs, [-F.rint(F.col("similarity") * 1e9), "slug_a", "slug_b"])
    return out.select("rank", "slug_a", "slug_b", F.round("similarity", 6).alias("similarity"))


def briefing_sections(spark: SparkSession, d: str) -> DataFrame:
    """The briefing's text by section, of all open link suggestions."""
    articles = view(spark, d, v.ARTICLES)
    hashed = articles.select("slug", "text", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    made = kept(similarity.link_suggestions(articles), "suggestions").withColumn("status", F.lit("open"))
    rows = ledger.first_ledger(findings.scored(findings.internal_link_findings(made)), NOW)
    return reporting.briefing_sections(reporting.briefing_rows(rows, hashed))


def recorded_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes after the openings of a plan, some of them merged at once, and after the
    reverts of changes that did harm."""
    known = view(spark, d, v.TIER_CHANGES).withColumn("file_path", F.lit("old/file")).withColumn("previous_content", F.lit(None).cast("string"))
    ready = known.filter("status = 'merged'").select("finding_type").distinct().select("finding_type", F.lit(10).cast("long").alias("consecutive_good"), F.lit(True).alias("auto_merge_eligible"))
    plan = changes.tier1_plan(view(spark, d, v.TIER_LEDGER), known, ready, cap=None)
    held = plan.select(F.col("target_file").alias("file_path")).distinct().withColumn("content", F.lit("before"))
    opened = changes.record_opened(known, plan, held)
    applied = view(spark, d, v.APPLIED_CHANGE)
    measured = impact.measure(impact.measurable(applied, CHANGES_AS_OF), view(spark, d, v.DAILY_CLICKS))
    reverts = impact.revert_plan(impact.impact_actions(impact.graduation_steps(measured), applied), applied)
    out = changes.record_reverts(opened, reverts)
    return out.groupBy("stable_key", "finding_type", "status", F.coalesce("previous_content", F.lit("")).alias("previous_content")).agg(F.count(F.lit(1)).alias("n"))


def audit_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two audits appended, each under one time, and the newest one read."""
    path = new_folder(spark, "audits")
    rows = view(spark, d, v.PERFORMANCE_AUDIT).select("id", "url", "performance_score", "run_no")
    sinks.append_batch(rows.filter("run_no < 2"), path, dt.datetime(2024, 1, 23, 6))
    sinks.append_batch(rows.filter("run_no >= 1"), path, dt.datetime(2024, 1, 30, 6))
    return findings.latest_batch(spark.read.parquet(path)).select("id", "url", "performance_score", "run_at")


def measured_once(spark: SparkSession, d: str) -> DataFrame:
    """Measurements appended by two runs that overlap: each change is there once."""
    path = new_folder(spark, "measured")
    rows = impact.measure(impact.measurable(view(spark, d, v.APPLIED_CHANGE), CHANGES_AS_OF), view(spark, d, v.DAILY_CLICKS))
    sinks.append_once(rows.filter("change_id % 3 < 2"), path, "change_id")
    sinks.append_once(rows.filter("change_id % 3 > 0").unionByName(rows.filter("change_id % 3 = 2")), path, "change_id")
    return spark.read.parquet(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (guarded_findings, ranked_pairs, briefing_sections, recorded_changes, audit_batches, measured_once)}

ORACLE_SQL = {
    "guarded_findings": """WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey, p_size % 2 AS stale FROM part)
        SELECT 'sitemap-out-of-domain' AS finding_type, 'URL fuera de dominio en el sitemap: ' || id AS stable_key_input, id FROM a WHERE p_partkey % 4 = 0
        UNION ALL SELECT 'sitemap-other', 'otro', id FROM a WHERE p_partkey % 4 = 0
        UNION ALL SELECT 'sitemap-stale-entries', 'sitemap-stale-entries', id FROM a WHERE stale > 0""",
    "ranked_pairs": f"""{_UNITS} SELECT row_number() OVER (ORDER BY round(s, 9) DESC, source_slug, target_slug) AS rank, source_slug AS slug_a, target_slug AS slug_b, round(s, 6) AS similarity
        FROM pairs WHERE source_slug < target_slug AND s >= 0.4""",
    "briefing_sections": f"""{_UNITS}, text_of AS (SELECT u.slug, coalesce(substr(d.text, 1, 2000), '') AS text FROM arts u LEFT JOIN documents d ON d.doc_id = u.vec_id), rows AS (
          SELECT sha256('internalLinking:internal-link:' || source_slug || ':' || target_slug) AS stable_key,
                 '## Posible enlace interno: ' || source_slug || ' → ' || target_slug || ' (similitud ' || printf('%.2f', round(s, 2)) || ')' || chr(10) || chr(10) || '- Tipo: internal-link-suggestion' || chr(10) || '- Prioridad: 2.0' || chr(10)
                 || chr(10) || '### Artículo origen (' || source_slug || ')' || chr(10) || chr(10) || a.text || chr(10) || chr(10) || '### Artículo destino (' || target_slug || ')' || chr(10) || chr(10) || b.text || chr(10) AS section
          FROM suggested JOIN text_of a ON a.slug = source_slug JOIN text_of b ON b.slug = target_slug
        ) SELECT row_number() OVER (ORDER BY stable_key) AS rank, section FROM rows
        UNION ALL SELECT 0, '# Briefing Tier 2' || chr(10) || chr(10) || count(*) || ' oportunidades para revisar.' || chr(10) || chr(10) FROM rows""",
    "recorded_changes": f"""{_IMPACT}, plan AS ({BATCH_SQL['tier1_plan']}), known AS ({v.TIER_CHANGES}), applied AS ({v.APPLIED_CHANGE}), every AS (
          SELECT stable_key, finding_type, status, '' AS previous_content FROM known
          UNION ALL SELECT stable_key, finding_type, CASE WHEN auto_merge THEN 'merged' ELSE 'open' END, 'before' FROM plan WHERE action = 'open'
          UNION ALL SELECT a.stable_key, 'revert', 'open', '' FROM applied a JOIN measured m ON m.change_id = a.id WHERE m.outcome = 'negative' AND a.file_path IS NOT NULL AND a.previous_content IS NOT NULL
        ) SELECT stable_key, finding_type, status, previous_content, count(*) AS n FROM every GROUP BY ALL""",
    "audit_batches": f"SELECT id, url, performance_score, TIMESTAMP '2024-01-30 06:00:00' AS run_at FROM ({v.PERFORMANCE_AUDIT}) WHERE run_no >= 1",
    "measured_once": BATCH_SQL["impact_measurement"],
}
