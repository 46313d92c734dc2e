"""Briefing, workflow health, alerts, and the views of the panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.order import ranked
from siteledger.functions.scalars import excerpt, fixed, half_up
from siteledger.operators.changes import tier_of

EXPIRES_WITHIN = 30


def _text_of(detail: Column, field: str) -> Column:
    """A field of a JSON text if it is a string that is not empty."""
    v = F.try_variant_get(detail, f"$.{field}", "variant")
    text = F.try_variant_get(detail, f"$.{field}", "string")
    return F.when((F.schema_of_variant(v) == "STRING") & (text != ""), text)


def link_details(rows: DataFrame) -> DataFrame:
    """rows with source_slug, target_slug and similarity read from detail, and
    well_formed: all three are there and of the right type."""
    v = F.try_parse_json("detail")
    number = F.schema_of_variant(F.try_variant_get(F.col("__v"), "$.similarity", "variant"))
    is_number = F.coalesce(number.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    out = rows.withColumn("__v", v).withColumn("source_slug", _text_of(F.col("__v"), "sourceSlug")).withColumn("target_slug", _text_of(F.col("__v"), "targetSlug"))
    out = out.withColumn("similarity", F.when(is_number, F.try_variant_get(F.col("__v"), "$.similarity", "double")))
    return out.withColumn("well_formed", F.col("source_slug").isNotNull() & F.col("target_slug").isNotNull() & F.col("similarity").isNotNull()).drop("__v")


def briefing_rows(ledger: DataFrame, articles: DataFrame) -> DataFrame:
    """Open tier-2 rows by priority. A link row that was rejected stays out while
    its source article (slug, content_hash, text) is as it was; link rows carry
    the beginning of both texts; malformed details are flagged."""
    rows = link_details(tier_of(ledger.filter("status = 'open'"), 2))
    is_link = F.col("finding_type") == "internal-link-suggestion"
    source = articles.select(F.col("slug").alias("source_slug"), F.col("content_hash").alias("__hash"), excerpt(F.col("text")).alias("source_text"))
    target = articles.select(F.col("slug").alias("target_slug"), excerpt(F.col("text")).alias("target_text"))
    rows = rows.join(source, "source_slug", "left").join(target, "target_slug", "left")
    same = F.coalesce(F.col("__hash") == F.col("reviewed_content_hash"), F.lit(False)) & F.col("well_formed")
    rows = rows.filter(~(is_link & same))
    malformed = is_link & ~F.col("well_formed")
    texts = [F.when(is_link & F.col("well_formed"), F.col(c)).alias(c) for c in ("source_slug", "target_slug", "source_text", "target_text")]
    return rows.select("stable_key", "finding_type", "title", "priority_score", "source_ref_id", malformed.alias("malformed"), *texts).orderBy(F.desc("priority_score"), "stable_key")


def _section() -> Column:
    link = F.concat(F.lit("\n### Artículo origen ("), "source_slug", F.lit(")\n\n"), F.coalesce("source_text", F.lit("")), F.lit("\n\n### Artículo destino ("), "target_slug", F.lit(")\n\n"), F.coalesce("target_text", F.lit("")), F.lit("\n"))
    bad = F.concat(F.lit("\n> ⚠️ Datos malformados para esta oportunidad (sourceRefId: "), F.coalesce("source_ref_id", F.lit("")), F.lit(").\n"))
    return F.concat(F.lit("## "), "title", F.lit("\n\n- Tipo: "), "finding_type", F.lit("\n- Prioridad: "), fixed(F.col("priority_score"), 1), F.lit("\n"), F.when(F.col("malformed"), bad).when(F.col("source_slug").isNotNull(), link).otherwise(F.lit("")))


def _heading(n: Column) -> Column:
    head = F.lit("# Briefing Tier 2\n\n")
    return F.when(n == 0, F.concat(head, F.lit("No hay oportunidades Tier 2 abiertas ahora mismo.\n"))).otherwise(F.concat(head, n.cast("string"), F.lit(" oportunidades para revisar.\n\n")))


def briefing_sections(rows: DataFrame) -> DataFrame:
    """rank and section: the briefing in pieces of Markdown, the heading at rank 0,
    however many rows there are; end to end they are the text of briefing_text, but
    for an empty line between sections."""
    sections = ranked(rows.select("stable_key", "priority_score", _section().alias("section")), [-F.col("priority_score"), "stable_key"])
    heading = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("rank"), _heading(F.col("n")).alias("section"))
    return heading.unionByName(sections.select("rank", "section"))


def briefing_text(rows: DataFrame) -> DataFrame:
    """One row, one column: the briefing as Markdown. It is read by a person, so
    it is one text."""
    parts = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("priority_score")).alias("p"), "stable_key", _section().alias("t")))).alias("x"))
    return parts.select(F.concat(_heading(F.size("x")), F.array_join(F.transform("x", lambda r: r["t"]), "\n")).alias("value"))


def workflow_health(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """workflow (and further keys), status and failed steps: failed if any step failed."""
    keys = by or ["workflow"]
    bad = F.col("outcome") == "failure"
    return steps.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "failed").otherwise("ok").alias("status"), F.count_if(bad).alias("failed_steps"))


def collection_counts(audits: DataFrame) -> DataFrame:
    """One row: how many rows a batch has, and how many of them could not be collected."""
    return audits.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size("errors") > 0).alias("failing"))


def alert_rows(rows: DataFrame, kind: Column, subject: Column, body: Column, now: dt.datetime) -> DataFrame:
    return rows.select(kind.alias("type"), subject.alias("subject"), body.alias("body"), F.lit(False).alias("acknowledged"), F.lit(now).cast("timestamp").alias("created_at"))


def workflow_alerts(health: DataFrame, now: dt.datetime) -> DataFrame:
    subject = F.concat(F.lit('Workflow "'), "workflow", F.lit('" tuvo al menos un paso fallido'))
    return alert_rows(health.filter("status = 'failed'"), F.lit("workflow-failed"), subject, subject, now)


def expiry_alerts(expirations: DataFrame, now: dt.datetime) -> DataFrame:
    """name and days_left of what expires within 30 days; what has no readable
    time gives no row."""
    seconds = F.unix_timestamp(F.expr("try_to_timestamp(expires_at)")) - F.unix_timestamp(F.lit(now).cast("timestamp"))
    return expirations.select("name", half_up(seconds / 86400).cast("long").alias("days_left")).filter(F.col("days_left") < EXPIRES_WITHIN)


def unread_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("acknowledged"))


def open_by_source(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'open'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def open_by_priority(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'open'").orderBy(F.desc("priority_score"), "stable_key")


def last_changes(changes: DataFrame, n: int = 20) -> DataFrame:
    return changes.orderBy(F.desc("merged_on"), F.desc("id")).limit(n)
