"""Landed files as tables: metric responses, page-speed reports, documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.scalars import compact_date, half_up

SEARCH_RESPONSE = "rows array<struct<keys: array<string>, clicks: double, impressions: double, ctr: double, position: double>>"
TRAFFIC_RESPONSE = "rows array<struct<dimensionValues: array<struct<value: string>>, metricValues: array<struct<value: string>>>>"
SPEED_REPORT = "url string, body string, fetch_error string"


def _key(k: int) -> Column:
    return F.coalesce(F.get("r.keys", F.lit(k)), F.lit(""))


def _rows(responses: DataFrame, keep_place: bool) -> tuple[DataFrame, list[str]]:
    """r, a response's row; with keep_place also arrived and its place in the response."""
    if not keep_place:
        return responses.select(F.explode("rows").alias("r")), []
    return responses.select("arrived", F.posexplode("rows").alias("place", "r")), ["arrived", "place"]


def search_rows(responses: DataFrame, keep_place: bool = False) -> DataFrame:
    """Search snapshot rows of responses (SEARCH_RESPONSE); missing text is empty,
    missing numbers are 0, a missing or unreadable date is null."""
    r, place = _rows(responses, keep_place)
    number = lambda c, kind: F.coalesce(F.col(f"r.{c}"), F.lit(0.0)).cast(kind).alias(c)
    return r.select(F.expr("try_cast(get(r.keys, 0) AS DATE)").alias("date"), _key(1).alias("page"), _key(2).alias("query"), number("clicks", "int"), number("impressions", "int"), number("ctr", "double"), number("position", "double"), *place)


def traffic_rows(responses: DataFrame, keep_place: bool = False) -> DataFrame:
    """Traffic snapshot rows of responses (TRAFFIC_RESPONSE)."""
    r, place = _rows(responses, keep_place)
    text = lambda k: F.coalesce(F.get("r.dimensionValues", F.lit(k))["value"], F.lit(""))
    number = lambda k: F.coalesce(F.get("r.metricValues", F.lit(k))["value"].try_cast("int"), F.lit(0))
    return r.select(compact_date(text(0)).alias("date"), text(1).alias("page"), text(2).alias("channel"), number(0).alias("sessions"), number(1).alias("engaged_sessions"), number(2).alias("conversions"), *place)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    return search_rows(spark.read.schema(SEARCH_RESPONSE).option("multiLine", True).json(path))


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    return traffic_rows(spark.read.schema(TRAFFIC_RESPONSE).option("multiLine", True).json(path))


def collection_window(rows: DataFrame, as_of: dt.date, days: int = 3) -> DataFrame:
    """The days that are collected again each run, because sources lag; both ends in."""
    return rows.filter(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))


def page_speed(reports: DataFrame) -> DataFrame:
    """url, performance_score, lcp (seconds), cls, inp and errors of SPEED_REPORT
    rows; a failed fetch, or a body that is no JSON, gives nulls and one error."""
    body = F.try_parse_json("body")
    get = lambda path: F.try_variant_get(F.col("v"), path, "double")
    failed = F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error")).when(F.col("v").isNull(), F.lit("not JSON"))
    return reports.withColumn("v", body).withColumn("failed", failed).select(
        "url",
        half_up(get("$.lighthouseResult.categories.performance.score") * 100).cast("int").alias("performance_score"),
        (get("$.lighthouseResult.audits['largest-contentful-paint'].numericValue") / 1000).alias("lcp"),
        get("$.lighthouseResult.audits['cumulative-layout-shift'].numericValue").alias("cls"),
        get("$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile").alias("inp"),
        F.when(F.col("failed").isNotNull(), F.array(F.concat(F.lit("No se pudo obtener PageSpeed Insights: "), "failed"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    ).select("url", *[F.when(F.size("errors") == 0, F.col(c)).alias(c) for c in ("performance_score", "lcp", "cls", "inp")], "errors")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """The columns of sitemaps (body) with loc and lastmod, a row for each url element."""
    parsed = sitemaps.withColumn("__x", F.from_xml("body", "url array<struct<loc: string, lastmod: string>>"))
    return parsed.withColumn("__u", F.explode("__x.url")).select(*sitemaps.columns, F.trim("__u.loc").alias("loc"), F.trim("__u.lastmod").alias("lastmod"))


def table(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """A pruned, filtered scan: both reach the Parquet reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)


def write_daily(rows: DataFrame, path: str) -> None:
    """A snapshot as a table partitioned by date, a file or more a day."""
    rows.repartition("date").write.partitionBy("date").parquet(path)
