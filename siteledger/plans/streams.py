"""Registered queries over tables that they store: streams, and tables laid out for
pruning and for joins without a shuffle.

Arrivals are derived from events and land week by
week; after each landing the streams run to the end of what is there and stop, as
scheduled jobs do, and the next run goes on from their checkpoints."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger import streaming
from siteledger.operators import findings, ledger, metrics, similarity
from siteledger.plans.oracle import ORACLE_SQL as BATCH_SQL
from siteledger.sinks import ledgers, newest_version, upsert_versions
from siteledger.sinks.snapshots import SnapshotTable
from siteledger.sources import landing
from siteledger.sources import views as v
from siteledger.sources.shared import kept, new_folder
from siteledger.sources.views import table, view

KEYS, FINAL = ["date", "page", "query"], "date date, page string, query string, clicks int, impressions int"

#: Each snapshot row arrives on its day, and is corrected twice, the second time
#: three to six days after its day.
CORRECTIONS = f"""
SELECT s.date, s.page, s.query, s.clicks + 7 * n AS clicks, s.impressions, n AS place,
       CAST(date_add(s.date, CAST(CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 + s.impressions % 3 ELSE 3 + s.clicks % 4 END AS INT)) AS TIMESTAMP) + INTERVAL '12' HOUR AS arrived
FROM ({v.SEARCH_SNAPSHOT}) s CROSS JOIN (SELECT explode(array(0, 1, 2)) AS n)
"""

#: Clicks of events; of ten events eight arrive at once, the others one to nine days later.
CLICKS = """
SELECT CAST(ts AS TIMESTAMP) AS ts, concat('/p/', CAST(user_id % 20 AS STRING)) AS page, event_id % 5 + 1 AS clicks,
       CAST(ts AS TIMESTAMP) + make_interval(0, 0, 0, CAST(CASE WHEN event_id % 10 < 8 THEN 0 ELSE 1 + event_id % 9 END AS INT)) AS arrived
FROM events
"""

#: Steps of workflow runs; a fifth of them arrive with a week's delay.
STEPS = """
SELECT concat('wf', CAST(user_id % 10 AS STRING)) AS workflow, CAST(ts AS DATE) AS run_on, event_id AS step_no,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
       CAST(ts AS TIMESTAMP) + make_interval(0, 0, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT)) AS arrived
FROM events
"""


def landed(rows: DataFrame, folder: str) -> list[Callable[[], None]]:
    """A step for each week of arrivals, that lands its rows as files in the folder."""
    week = F.floor(F.date_diff(F.col("arrived").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    weeks = [r.w for r in rows.select(week.alias("w")).distinct().orderBy("w").collect()]  # a row a week
    return [lambda w=w: rows.filter(week == w).write.mode("append").parquet(folder) for w in weeks]


def streamed_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot rows as the last correction in time left them, of all final days."""
    session = streaming.streaming_session(spark)
    rows = kept(view(session, d, CORRECTIONS), "arrivals")  # each week lands from it
    land, out, at = (new_folder(spark, n) for n in ("corrections-landing", "corrections", "corrections-checkpoint"))
    for step in landed(rows, land):
        step()
        stream = session.readStream.schema(rows.schema).parquet(land)
        streaming.final_rows(streaming.last_arrivals(stream, KEYS, ["arrived", "place"]), out, FINAL, KEYS, at).awaitTermination()
    return SnapshotTable(spark, out, FINAL).read()


def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of each final day and page, on time and late, and how many rows and
    clicks came too late to count."""
    session = streaming.streaming_session(spark)
    rows = view(session, d, CLICKS)
    land, totals, late, at, at_late = (new_folder(spark, n) for n in ("clicks-landing", "totals", "too-late", "totals-checkpoint", "too-late-checkpoint"))
    for step in landed(rows, land):
        step()
        stream = session.readStream.schema(rows.schema).parquet(land)
        both = [streaming.append_stream(streaming.daily_totals(stream), totals, at), streaming.append_stream(streaming.too_late(stream), late, at_late)]
        for query in both:
            query.awaitTermination()
    final = spark.read.schema("day date, page string, clicks long, late_clicks long").parquet(totals)
    missed = spark.read.schema(rows.schema).parquet(late).groupBy(F.col("ts").cast("date").alias("day"), "page").agg(F.count(F.lit(1)).alias("too_late_rows"), F.sum("clicks").alias("too_late_clicks"))
    return final.join(missed, ["day", "page"], "left").fillna(0, ["too_late_rows", "too_late_clicks"])


def streamed_health(spark: SparkSession, d: str) -> DataFrame:
    """Newest run of each workflow with its failed steps, from state kept over batches."""
    session = streaming.streaming_session(spark)
    rows = view(session, d, STEPS)
    land, at = new_folder(spark, "steps-landing"), new_folder(spark, "health-checkpoint")
    versions = new_folder(spark, "health")
    for step in landed(rows, land):
        step()
        stream = session.readStream.schema(rows.schema).parquet(land)
        streaming.run_to_end(streaming.newest_runs(stream), upsert_versions(versions, ["workflow", "part"]), at, "update")
    return streaming.workflow_status(newest_version(spark, versions))


def pruned_decline(spark: SparkSession, d: str) -> DataFrame:
    """Declining pages from a snapshot partitioned by date, of the windows of a table
    of runs."""
    snap, runs = new_folder(spark, "snapshot"), new_folder(spark, "runs")
    landing.write_daily(view(spark, d, v.SEARCH_SNAPSHOT), snap)
    table(spark, d, "events").select(F.lit("daily").alias("run"), F.col("ts").cast("date").alias("as_of")).groupBy("run").agg(F.max("as_of").alias("as_of")).write.parquet(runs)
    rows = metrics.in_windows(spark.read.parquet(snap), spark.read.parquet(runs).filter("run = 'daily'"))
    return metrics.declining_pages(rows, v.AS_OF).select("page", "prior_clicks", "recent_clicks", F.round("decline", 6).alias("decline"))


def bucketed_sync(spark: SparkSession, d: str) -> DataFrame:
    """opportunity_sync over ledger tables bucketed by key."""
    snap = view(spark, d, v.SEARCH_SNAPSHOT)
    found = lambda day: findings.scored(findings.current_findings(day, snapshot=snap.filter(F.col("date") <= F.lit(day))))
    one, two = (f"ledger_{uuid.uuid4().hex}" for _ in range(2))
    ledgers.bucketed(ledger.first_ledger(found(v.LEDGER_AS_OF), dt.datetime(2024, 1, 23)), one, new_folder(spark, "ledger"))
    out = ledgers.next_ledger(spark, one, two, new_folder(spark, "ledger"), found(v.AS_OF), dt.datetime(2024, 1, 30))
    return out.select("stable_key", "finding_type", "status", "action", "first_detected_at", "resolved_at")


def bucketed_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """suggestion_sync over suggestion tables bucketed by key."""
    new = kept(similarity.link_suggestions(view(spark, d, v.SLUGS)), "suggestions")
    n = F.regexp_extract("target_slug", "v([0-9]+)$", 1).cast("long") % 3
    one, two = (f"suggestion_{uuid.uuid4().hex}" for _ in range(2))
    ledgers.bucketed(new.filter(n < 2).withColumn("status", F.lit("open")), one, new_folder(spark, "suggestion"))
    out = ledgers.next_suggestions(spark, one, two, new_folder(spark, "suggestion"), new.filter(n > 0))
    return out.select("stable_key", "source_slug", "target_slug", "status", "action")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (streamed_corrections, streamed_totals, streamed_health, pruned_decline, bucketed_sync, bucketed_suggestions)}

ORACLE_SQL = {
    "pruned_decline": f"SELECT page, prior_clicks, recent_clicks, decline FROM ({BATCH_SQL['content_declining']})",
    "bucketed_sync": BATCH_SQL["opportunity_sync"],
    "bucketed_suggestions": BATCH_SQL["suggestion_sync"],
    "streamed_corrections": f"""WITH s AS ({v.SEARCH_SNAPSHOT}), a AS (
          SELECT date, page, query, CAST(clicks + 7 * n AS INT) AS clicks, impressions, n, date + CAST(CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 + impressions % 3 ELSE 3 + clicks % 4 END AS INT) AS arrived
          FROM s, (VALUES (0), (1), (2)) c(n)
        ), k AS (SELECT *, row_number() OVER (PARTITION BY date, page, query ORDER BY arrived DESC, n DESC) AS back FROM a WHERE arrived < date + 4)
        SELECT date, page, query, clicks, impressions FROM k WHERE back = 1 AND date + 4 <= (SELECT max(date) FROM a)""",
    "streamed_totals": """WITH c AS (
          SELECT ts, CAST(ts AS DATE) AS day, concat('/p/', CAST(user_id % 20 AS STRING)) AS page, event_id % 5 + 1 AS clicks,
                 ts + to_days(CAST(CASE WHEN event_id % 10 < 8 THEN 0 ELSE 1 + event_id % 9 END AS INT)) AS arrived FROM events
        ), k AS (SELECT *, CASE WHEN arrived < day + 1 THEN 'on time' WHEN arrived <= CAST(day + 4 AS TIMESTAMP) THEN 'late' ELSE 'too late' END AS kind FROM c),
        f AS (
          SELECT day, page, CAST(coalesce(sum(clicks) FILTER (kind = 'on time'), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(clicks) FILTER (kind = 'late'), 0) AS BIGINT) AS late_clicks,
                 count(*) FILTER (kind = 'too late') AS too_late_rows, CAST(coalesce(sum(clicks) FILTER (kind = 'too late'), 0) AS BIGINT) AS too_late_clicks, bool_or(kind <> 'too late') AS counted
          FROM k GROUP BY day, page
        ) SELECT day, page, clicks, late_clicks, too_late_rows, too_late_clicks FROM f WHERE counted AND day + 4 <= (SELECT max(ts) FROM events)""",
    "streamed_health": f"""WITH w AS ({v.WORKFLOW_RUN}), n AS (SELECT w.* FROM w JOIN (SELECT workflow, max(run_on) AS run_on FROM w GROUP BY workflow) l ON w.workflow = l.workflow AND w.run_on = l.run_on)
        SELECT workflow, run_on, CASE WHEN bool_or(outcome = 'failure') THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (outcome = 'failure') AS failed_steps FROM n GROUP BY workflow, run_on""",
}
