"""Audit rows to findings, and findings to scored, deduplicated ones."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import finding_rules
from siteledger.functions.scalars import fixed, priority, shown, stable_key, string_array
from siteledger.operators import metrics

COLUMNS = ["source", "finding_type", "stable_key_input", "title", "detail", "source_ref_id"]

# How audit messages begin.
MALFORMED = "El XML del sitemap parece estar mal formado"
OUT_OF_DOMAIN = "URL fuera de dominio en el sitemap: "
SITEMAP_FAILED = "No se pudo obtener el sitemap: "
NO_DIRECTIVE = "robots.txt no declara ninguna directiva Sitemap:"
BLOCKS_ALL = "robots.txt contiene 'Disallow: /'"
ROBOTS_FAILED = "No se pudo obtener robots.txt: "


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _classified(rows: DataFrame, source: str, cases: list[tuple[Column, str, str | None]]) -> DataFrame:
    """A finding for each message m of rows; a case has a condition, a type and
    a title. Without a title, the message is title and key."""
    kind = key = title = None
    for when, name, text in cases:
        pick = lambda chain, value: F.when(when, value) if chain is None else chain.when(when, value)
        kind = pick(kind, F.lit(name))
        key = pick(key, F.lit(name) if text else F.col("m"))
        title = pick(title, F.lit(text) if text else F.col("m"))
    return rows.select(F.lit(source).alias("source"), kind.otherwise(f"{source}-other").alias("finding_type"), key.otherwise(F.col("m")).alias("stable_key_input"), title.otherwise(F.col("m")).alias("title"), F.col("m").alias("detail"), F.col("id").alias("source_ref_id"))


def _messages(audits: DataFrame) -> DataFrame:
    """id and m, a row a message; errors that are no array hold none."""
    return audits.select("id", F.explode(string_array(F.col("errors"), audits.schema["errors"].dataType)).alias("m"))


def sitemap_findings(audits: DataFrame) -> DataFrame:
    m = F.col("m")
    messages = _classified(_messages(audits), "sitemap", [
        (m.startswith(MALFORMED), "sitemap-malformed", "El sitemap XML está mal formado"),
        (m.startswith(OUT_OF_DOMAIN), "sitemap-out-of-domain", None),
        (m.startswith(SITEMAP_FAILED), "sitemap-fetch-failed", "No se pudo obtener el sitemap"),
    ])
    n = F.col("stale_entries")
    stale = audits.filter(n > 0).select(
        F.lit("sitemap").alias("source"), F.lit("sitemap-stale-entries").alias("finding_type"), F.lit("sitemap-stale-entries").alias("stable_key_input"),
        F.concat(n.cast("string"), F.lit(" URLs del sitemap tienen un lastmod obsoleto (>400 días)")).alias("title"), F.to_json(F.struct(n.alias("staleEntries"))).alias("detail"), F.col("id").alias("source_ref_id"),
    )
    return union(messages, stale)


def robots_findings(audits: DataFrame) -> DataFrame:
    m = F.col("m")
    return _classified(_messages(audits), "robots", [
        (m == NO_DIRECTIVE, "robots-missing-sitemap-directive", "robots.txt no declara ninguna directiva Sitemap"),
        (m.startswith(BLOCKS_ALL), "robots-blocks-all", "robots.txt bloquea la indexación de todo el sitio"),
        (m.startswith(ROBOTS_FAILED), "robots-fetch-failed", "No se pudo obtener robots.txt"),
    ])


def structured_data_findings(audits: DataFrame) -> DataFrame:
    kind = F.when(F.col("schema_type") == "none", "structured-data-missing").when(F.col("schema_type") == "invalid-json", "structured-data-invalid-json").otherwise("structured-data-missing-field")
    rows = audits.filter(~F.col("is_valid")).withColumn("k", kind)
    field = F.col("k") == "structured-data-missing-field"
    title = F.when(field, F.concat(F.lit("Campos requeridos faltantes en el schema "), "schema_type", F.lit(" de "), "url")).when(F.col("k") == "structured-data-missing", F.concat(F.lit("Sin datos estructurados en "), "url")).otherwise(F.concat(F.lit("JSON-LD inválido en "), "url"))
    return rows.select(F.lit("structuredData").alias("source"), F.col("k").alias("finding_type"), F.concat_ws(":", "k", "url", F.when(field, F.col("schema_type"))).alias("stable_key_input"), title.alias("title"), F.to_json("errors").alias("detail"), F.col("id").alias("source_ref_id"))


def performance_findings(audits: DataFrame) -> DataFrame:
    """A finding for each measure beyond its limit; nulls breach nothing."""

    def breach(test: Column, name: str, label: str, value: Column, key: str, mark: str = "") -> Column:
        title = F.concat(F.lit(label + " ("), shown(value), F.lit(mark + ") en "), F.col("url"))
        return F.when(test, F.struct(F.lit(name).alias("finding_type"), title.alias("title"), F.to_json(F.struct(value.alias(key))).alias("detail")))

    lcp, cls, inp, score = (F.col(c) for c in ("lcp", "cls", "inp", "performance_score"))
    all_ = F.array(
        breach(lcp > 4, "performance-lcp-red", "LCP en rojo", lcp, "lcp", "s"),
        breach(cls > 0.25, "performance-cls-red", "CLS en rojo", cls, "cls"),
        breach(inp > 500, "performance-inp-red", "INP en rojo", inp, "inp", "ms"),
        breach(score < 50, "performance-low-score", "Puntuación PageSpeed baja", score, "performanceScore"),
    )
    rows = audits.withColumn("x", F.explode(F.filter(all_, lambda x: x.isNotNull())))
    return rows.select(F.lit("performance").alias("source"), "x.finding_type", F.concat_ws(":", "x.finding_type", "url").alias("stable_key_input"), "x.title", "x.detail", F.col("id").alias("source_ref_id"))


def internal_link_findings(suggestions: DataFrame) -> DataFrame:
    rows = suggestions.filter(F.col("status") == "open")
    title = F.concat(F.lit("Posible enlace interno: "), "source_slug", F.lit(" → "), "target_slug", F.lit(" (similitud "), fixed(F.col("similarity"), 2), F.lit(")"))
    detail = F.to_json(F.struct(F.col("source_slug").alias("sourceSlug"), F.col("target_slug").alias("targetSlug"), "similarity"))
    return rows.select(F.lit("internalLinking").alias("source"), F.lit("internal-link-suggestion").alias("finding_type"), F.concat_ws(":", F.lit("internal-link"), "source_slug", "target_slug").alias("stable_key_input"), title.alias("title"), detail.alias("detail"), F.col("stable_key").alias("source_ref_id"))


def latest_batch(rows: DataFrame, run: str = "run_at") -> DataFrame:
    """All rows of the newest run: a join with its one-row maximum."""
    newest = rows.agg(F.max(run).alias("__run"))
    return rows.join(F.broadcast(newest), F.col(run) == F.col("__run")).drop("__run")


def latest_row(rows: DataFrame, run: str = "run_at") -> DataFrame:
    return rows.orderBy(F.desc(run), "id").limit(1)


def current_findings(
    as_of: dt.date, snapshot: DataFrame | None = None, sitemap: DataFrame | None = None, robots: DataFrame | None = None,
    structured_data: DataFrame | None = None, performance: DataFrame | None = None, suggestions: DataFrame | None = None,
) -> DataFrame:
    """What the daily run finds now, from the tables given."""
    found = []
    if sitemap is not None:
        found.append(sitemap_findings(latest_row(sitemap)))
    if robots is not None:
        found.append(robots_findings(latest_row(robots)))
    if structured_data is not None:
        found.append(structured_data_findings(latest_batch(structured_data)))
    if performance is not None:
        found.append(performance_findings(latest_batch(performance)))
    if suggestions is not None:
        found.append(internal_link_findings(suggestions))
    if snapshot is not None:
        found += [metrics.competing_findings(snapshot, as_of), metrics.declining_findings(snapshot, as_of), metrics.query_gap_findings(snapshot, as_of)]
    return union(*found)


def scored(findings: DataFrame) -> DataFrame:
    """One row a stable key, with impact, effort, priority and tier."""
    rules = F.broadcast(finding_rules(findings.sparkSession))  # 23 rows
    keyed = findings.withColumn("stable_key", stable_key("source", "stable_key_input"))
    one = keyed.groupBy("stable_key").agg(F.max_by(F.struct(*COLUMNS), F.struct("source_ref_id", "title")).alias("x")).select("stable_key", "x.*")
    return one.join(rules, "finding_type").withColumn("priority_score", priority(F.col("impact"), F.col("effort"))).drop("rule_source")
