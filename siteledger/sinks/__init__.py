"""Writers: keyed overwrites, appends, versions, and the briefing file."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path, or an empty one if there is none yet; other errors are raised."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def upsert_by_date(rows: DataFrame, path: str, keys: list[str], arrival: list[str] | None = None) -> None:
    """Upserts into a table partitioned by date: only partitions with new rows are
    rewritten. Of rows with one key the last in the order of the arrival columns
    wins, which are not stored; without them the largest row does. Rows without a
    date are kept together. The new content is stored beside the table first, under
    a name of its own, so no file is overwritten while it is read."""
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in (arrival or [])]
    rest = [c for c in columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(arrival or rest))).alias("x")).select(*keys, "x.*")
    old = read_or_empty(spark, path, one.select(*columns).schema).select(*columns)
    days = one.select(F.col("date").alias("__day")).distinct()
    touched = old.join(F.broadcast(days), F.col("date").eqNullSafe(F.col("__day")), "left_semi")  # a row a day of the batch
    now = one.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    merged = touched.join(now, same, "left_anti").unionByName(one)
    aside = f"{path.rstrip('/')}-next-{uuid.uuid4().hex}"
    merged.write.parquet(aside)
    (spark.read.parquet(aside).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def append_batch(rows: DataFrame, path: str, run_at: dt.datetime) -> None:
    """Appends audit rows; the whole batch shares one run_at."""
    rows.withColumn("run_at", F.lit(run_at).cast("timestamp")).write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not there yet."""
    known = read_or_empty(rows.sparkSession, path, rows.schema).select(key)
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def write_version(rows: DataFrame, folder: str, version: int) -> str:
    """Writes a new version of a merged table; readers take the newest one whole."""
    path = f"{folder.rstrip('/')}/v{version:08d}"
    rows.write.parquet(path)
    return path


def upsert_versions(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink of a stream in update mode: batch n is upserted by key into version n - 1
    and stored as version n. A batch that is run again writes the same version."""

    def one(batch: DataFrame, number: int) -> None:
        from siteledger.operators.ledger import upsert

        path = f"{folder.rstrip('/')}/version="
        if number:
            batch = upsert(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}{number - 1}"), batch, keys)
        batch.write.mode("overwrite").parquet(f"{path}{number}")

    return one


def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The table as the last batch of upsert_versions left it."""
    versions = spark.read.parquet(folder)
    last = versions.select("version").agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version")


def write_text(briefing: DataFrame, path: str) -> None:
    """One text in one file."""
    briefing.coalesce(1).write.mode("overwrite").text(path)
