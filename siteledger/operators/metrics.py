"""Finders over daily search metrics: declining pages, competing pages, query gaps.

All give rows of schemas.FINDING plus `as_of` order columns where one run can
find a key twice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.scalars import decline, fixed, ratio_or_zero

RECENT_DAYS, HISTORY_DAYS = 14, 90
DECLINE_FROM = 0.3
GAP_IMPRESSIONS, GAP_CTR, GAP_POSITION = 100, 0.01, 10


def recent(snapshot: DataFrame, as_of: dt.date, days: int = RECENT_DAYS, end: dt.date | None = None) -> DataFrame:
    """date >= as_of - days (up to end, if given)."""
    rows = snapshot.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days)))
    return rows if end is None else rows.filter(F.col("date") <= F.lit(end))


def prior(snapshot: DataFrame, as_of: dt.date, days: int = RECENT_DAYS) -> DataFrame:
    """The days before the recent ones."""
    return snapshot.filter((F.col("date") >= F.lit(as_of - dt.timedelta(2 * days))) & (F.col("date") < F.lit(as_of - dt.timedelta(days))))


def in_windows(snapshot: DataFrame, runs: DataFrame, days: int = 2 * RECENT_DAYS) -> DataFrame:
    """Rows of the days that the windows of runs (as_of) reach back to. The days, a
    few a run, are joined to the snapshot's date, so that of a table partitioned by
    date only their partitions are read, though as_of is known only at run time."""
    wanted = runs.select(F.explode(F.sequence(F.date_sub("as_of", days), "as_of")).alias("date")).distinct()
    return snapshot.join(F.broadcast(wanted), "date", "left_semi")  # a row a day of the windows


def clicks_by_page(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("page").agg(F.sum("clicks").alias("clicks"))


def declining_pages(snapshot: DataFrame, as_of: dt.date, include_vanished: bool = False) -> DataFrame:
    """page, prior_clicks, recent_clicks, decline of pages that lost 30 % or more.

    Both windows come from one scan and one aggregation; a page must have rows
    in the recent window unless include_vanished."""
    split = F.lit(as_of - dt.timedelta(RECENT_DAYS))
    rows = snapshot.filter(F.col("date") >= F.lit(as_of - dt.timedelta(2 * RECENT_DAYS)))
    sums = rows.groupBy("page").agg(
        F.sum(F.when(F.col("date") >= split, F.col("clicks"))).alias("recent_clicks"),
        F.sum(F.when(F.col("date") < split, F.col("clicks"))).alias("prior_clicks"),
    )
    if include_vanished:
        sums = sums.fillna(0, ["recent_clicks"])
    sums = sums.filter("recent_clicks is not null and prior_clicks > 0")
    out = sums.withColumn("decline", decline(F.col("prior_clicks"), F.col("recent_clicks")))
    return out.filter(F.col("decline") >= DECLINE_FROM).select("page", "prior_clicks", "recent_clicks", "decline")


def declining_findings(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    rows = declining_pages(snapshot, as_of)
    title = F.concat("page", F.lit(" ha bajado un "), fixed(F.col("decline") * 100, 0), F.lit("% en clics ("), F.col("prior_clicks").cast("string"), F.lit(" → "), F.col("recent_clicks").cast("string"), F.lit(")"))
    return rows.select(
        F.lit("content").alias("source"), F.lit("content-declining").alias("finding_type"), F.concat(F.lit("content-declining:"), "page").alias("stable_key_input"),
        title.alias("title"), F.to_json(F.struct("page", F.col("prior_clicks").alias("priorClicks"), F.col("recent_clicks").alias("recentClicks"), "decline")).alias("detail"), F.col("page").alias("source_ref_id"),
    )


def competing_pages(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    """query and its sorted pages, for queries with two pages or more."""
    pages = recent(snapshot, as_of).select("query", "page").distinct().groupBy("query").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return pages.filter(F.size("pages") >= 2)


def competing_findings(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    title = F.concat(F.lit('"'), "query", F.lit('" recibe impresiones desde '), F.size("pages").cast("string"), F.lit(" páginas distintas: "), F.array_join("pages", ", "))
    return competing_pages(snapshot, as_of).select(
        F.lit("content").alias("source"), F.lit("content-cannibalization").alias("finding_type"), F.concat(F.lit("content-cannibalization:"), "query").alias("stable_key_input"),
        title.alias("title"), F.to_json(F.struct("query", "pages")).alias("detail"), F.col("query").alias("source_ref_id"),
    )


def query_gaps(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows with many impressions, hardly a click and a low place, one a page and
    query: the latest day's, then the one with most impressions."""
    rows = recent(snapshot, as_of).withColumn("ctr", ratio_or_zero(F.col("clicks"), F.col("impressions")))
    hit = rows.filter((F.col("impressions") >= GAP_IMPRESSIONS) & (F.col("ctr") < GAP_CTR) & (F.col("position") > GAP_POSITION))
    return hit.groupBy("page", "query").agg(F.max_by(F.struct("date", "clicks", "impressions", "position"), F.struct("date", "impressions")).alias("x")).select("page", "query", "x.*")


def query_gap_findings(snapshot: DataFrame, as_of: dt.date) -> DataFrame:
    title = F.concat(F.lit('"'), "query", F.lit('" tiene '), F.col("impressions").cast("string"), F.lit(" impresiones pero posición "), fixed(F.col("position"), 1), F.lit(" en "), "page")
    return query_gaps(snapshot, as_of).select(
        F.lit("content").alias("source"), F.lit("content-query-gap").alias("finding_type"), F.concat_ws(":", F.lit("content-query-gap"), "page", "query").alias("stable_key_input"),
        title.alias("title"), F.to_json(F.struct("page", "query", "impressions", "clicks", "position")).alias("detail"), F.concat_ws(":", "page", "query").alias("source_ref_id"),
    )


def daily_clicks(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy(F.col("date").alias("day"), "page").agg(F.sum("clicks").alias("clicks"))
