"""Streaming forms of the collectors, workflow health and daily click totals.

How late a row may be is a rule about the row: it arrived within LATENESS days of
the end of its day, or it did not. Watermarks then only say when a day is final.
A row is never seen before its day, so the newest day seen, less the lateness, is
not past a day whose rows may still come: no row that the rule admits is dropped by
a watermark, and results do not depend on how arrivals are cut into batches.

State is Spark's own, in RocksDB: aggregations for corrections and totals, one
value a workflow and part for health. A query that ends, or is lost, goes on from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siteledger.sinks import upsert_by_date
from siteledger.sinks.snapshots import SnapshotTable
from siteledger.sources.landing import SEARCH_RESPONSE, TRAFFIC_RESPONSE, search_rows, traffic_rows

LATENESS = 3
ARRIVAL = ["arrived", "place"]
ON_TIME, LATE, TOO_LATE = "on time", "late", "too late"
#: Parts of a workflow's steps, so that one workflow with most steps is no hot key.
PARTS = 16


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with state in RocksDB. Settings of the
    given session are neither changed nor needed while a stream runs."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def stream_responses(spark: SparkSession, folder: str, kind: str = "search") -> DataFrame:
    """Snapshot rows of response files as they land, with when the file arrived
    and the row's place in it (ARRIVAL)."""
    schema, rows = (SEARCH_RESPONSE, search_rows) if kind == "search" else (TRAFFIC_RESPONSE, traffic_rows)
    files = spark.readStream.schema(schema).option("multiLine", True).json(folder)
    return rows(files.withColumn("arrived", F.struct("_metadata.file_modification_time", "_metadata.file_path")), keep_place=True)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts each batch by key; a batch that is run again writes the same rows.
    Of a key's rows in a batch the one that arrived last wins."""
    arrival = [c for c in ARRIVAL if c in rows.columns]

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_by_date(batch, path, keys, arrival or None)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def punctuality(day: Column, arrived: Column, lateness: int = LATENESS) -> Column:
    """on time: arrived before its day was over; late: within lateness days of the
    day's end; too late: after that. A row without a day or arrival is too late."""
    end = F.date_add(day, 1).cast("timestamp")
    return F.when(arrived < end, ON_TIME).when(arrived <= F.timestamp_add("DAY", F.lit(lateness), end), LATE).otherwise(TOO_LATE)


def last_arrivals(rows: DataFrame, keys: list[str], arrival: list[str], lateness: int = LATENESS) -> DataFrame:
    """From a stream of rows with date and arrival columns (the first a timestamp):
    the row of each key that arrived last, once no more corrections count. Rows
    that are too late are left out; use in append mode."""
    values = [c for c in rows.columns if c not in [*keys, *arrival]]
    known = rows.filter(punctuality(F.col("date"), F.col(arrival[0]), lateness) != TOO_LATE)
    timed = known.withColumn("__day", F.col("date").cast("timestamp")).withWatermark("__day", f"{lateness} days")
    others = [k for k in keys if k != "date"]
    last = F.max_by(F.struct(*values), F.struct(*arrival, *values))
    out = timed.groupBy(F.window("__day", "1 day").alias("__w"), *others).agg(last.alias("__x"))
    return out.select(F.col("__w.start").cast("date").alias("date"), *others, "__x.*")


def final_rows(rows: DataFrame, path: str, schema: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Final rows of last_arrivals, upserted into the snapshot table at path; a batch
    that is run again puts the same rows there."""

    def one(batch: DataFrame, _: int) -> None:
        SnapshotTable(batch.sparkSession, path, schema).upsert(batch, keys)

    return rows.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_health(steps: DataFrame) -> DataFrame:
    """The newest run of each workflow and its status, from a stream of steps
    (workflow, run_on, outcome), without state of its own; use in update mode.
    `newest_runs` also counts failed steps."""
    bad = F.max(F.when(F.col("outcome") == "failure", F.col("run_on"))).alias("last_failed_on")
    per = steps.groupBy("workflow").agg(F.max("run_on").alias("run_on"), bad)
    failed = F.coalesce(F.col("last_failed_on") == F.col("run_on"), F.lit(False))
    return per.select("workflow", "run_on", F.when(failed, "failed").otherwise("ok").alias("status"))


class NewestRun(StatefulProcessor):
    """Keeps the newest run of a workflow's part and how many of its steps failed;
    a newer run starts from 0, steps of older ones are left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run_on date, failed_steps long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, failed = self.run.get() if self.run.exists() else (None, 0)
        for batch in rows:
            batch = batch[batch["run_on"].notna()]
            if not len(batch):
                continue
            last = batch["run_on"].max()
            if newest is None or last > newest:
                newest, failed = last, 0
            failed += int(((batch["run_on"] == newest) & (batch["outcome"] == "failure")).sum())
        if newest is None:
            return
        self.run.update((newest, failed))
        yield pd.DataFrame({"workflow": [key[0]], "part": [key[1]], "run_on": [newest], "failed_steps": [failed]})

    def close(self) -> None:
        pass


def newest_runs(steps: DataFrame, parts: int = PARTS) -> DataFrame:
    """workflow, part, run_on and failed_steps from a stream of steps (workflow,
    run_on, step_no, outcome), which keep a state for each workflow and part; use in
    update mode, and `workflow_status` to put the parts together."""
    part = F.pmod(F.xxhash64("step_no"), F.lit(parts)).cast("int").alias("part")
    dealt = steps.select("workflow", part, "run_on", "outcome")
    return dealt.groupBy("workflow", "part").transformWithStateInPandas(NewestRun(), "workflow string, part int, run_on date, failed_steps long", "Update", "None")


def workflow_status(table: DataFrame) -> DataFrame:
    """workflow, run_on, status and failed_steps of the newest run, as the batch form
    gives them, from the rows that newest_runs keeps up to date."""
    newest = table.groupBy("workflow", "run_on").agg(F.sum("failed_steps").alias("failed_steps"))
    last = newest.groupBy("workflow").agg(F.max_by(F.struct("run_on", "failed_steps"), "run_on").alias("x"))
    return last.select("workflow", "x.run_on", F.when(F.col("x.failed_steps") > 0, "failed").otherwise("ok").alias("status"), "x.failed_steps")


def daily_totals(clicks: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """day, page, clicks that were on time, and clicks that came late, from a stream
    (ts, page, clicks, and arrived if rows say when they did). In append mode a day
    is given once, when it is final; rows that are too late do not count here."""
    arrived = F.col("arrived") if "arrived" in clicks.columns else F.col("ts")
    timed = clicks.withColumn("__kind", punctuality(F.col("ts").cast("date"), arrived, lateness)).filter(F.col("__kind") != TOO_LATE).withWatermark("ts", f"{lateness} days")
    sums = [F.sum(F.when(F.col("__kind") == kind, F.col("clicks")).otherwise(0)).alias(name) for kind, name in ((ON_TIME, "clicks"), (LATE, "late_clicks"))]
    return timed.groupBy(F.window("ts", "1 day").alias("__w"), "page").agg(*sums).select(F.col("__w.start").cast("date").alias("day"), "page", "clicks", "late_clicks")


def too_late(clicks: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """Rows of the stream that daily_totals leaves out, as they are."""
    return clicks.filter(punctuality(F.col("ts").cast("date"), F.col("arrived"), lateness) == TOO_LATE)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each row once into Parquet files, whose log the next run goes on with."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
