"""Ledgers as tables bucketed by stable_key.

The daily merge joins the whole ledger with the few findings of a run. A bucketed
table is dealt by key as it lies, so the join moves the findings only; the merged
rows stay where they are and are written as the next version, bucketed again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteledger.operators.ledger import sync_opportunities, sync_suggestions

KEY = "stable_key"


def bucketed(rows: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """rows stored at path as the catalog's table name, in buckets of stable_key: as
    many as a shuffle has parts by default; with fewer, Spark would rather shuffle
    both sides of a join."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, KEY).write.bucketBy(n, KEY).sortBy(KEY).option("path", path).saveAsTable(name)
    return spark.table(name)


def next_version(spark: SparkSession, name: str, following: str, path: str, merge: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> DataFrame:
    """merge of the table name, a full-outer join on its key, as the table following."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The join's parts are the buckets, so each task writes one.
    merge(spark.table(name)).write.bucketBy(n, KEY).sortBy(KEY).option("path", path).saveAsTable(following)
    return spark.table(following)


def next_ledger(spark: SparkSession, name: str, following: str, path: str, found: DataFrame, now: dt.datetime, scope: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Syncs the ledger table name with the findings of a run into the table
    following; gives that table, with the action taken on each row."""
    return next_version(spark, name, following, path, lambda ledger: sync_opportunities(ledger, found, now, scope), buckets)


def next_suggestions(spark: SparkSession, name: str, following: str, path: str, pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """As next_ledger, of the table of link suggestions and a run's pairs."""
    return next_version(spark, name, following, path, lambda old: sync_suggestions(old, pairs), buckets)
