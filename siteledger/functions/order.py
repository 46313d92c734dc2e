"""Ranks of whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteledger.sources.shared import kept

_ROWS = 1 << 33  # rows of a partition in a monotonically increasing id


def ranked(df: DataFrame, order: list[str | Column], out: str = "rank") -> DataFrame:
    """df with out: each row's number from 1 on in the given order, which must tell
    all rows apart for the numbers to be the same each time.

    Rows are dealt to ranges of the order and sorted and numbered there; stored, they
    keep their ranges, whose sizes, a row a range, give each its first number."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__{out}{n}" for n in range(len(cols))]
    dealt = df.select("*", *[c.alias(k) for c, k in zip(cols, keys)])
    spread = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = kept(spread.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("__part", F.floor(F.col("__id") / _ROWS))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # a row a range
    number = F.col("__before") + F.col("__id") % _ROWS + 1
    return rows.join(F.broadcast(sizes), "__part").withColumn(out, number.cast("long")).drop("__part", "__before", "__id")
