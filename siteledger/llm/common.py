"""What the operators share: stored steps, spread-out ranks, row hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and Spark runs in this process, as in tests, a folder is
    made. On a cluster that is an error: other machines would not see the folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """df written once to the shared folder and read back, so that later jobs
    neither compute it again nor depend on any executor. Shuffle files of the
    write go as soon as it ends: nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    """How many parts a shuffle makes: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str | Column) -> Column:
    """A hash that orders rows in a way that does not follow their ids."""
    return F.xxhash64(*cols, F.lit(0x5EED))


def sheltered(docs: DataFrame, step: Callable[[DataFrame], DataFrame], known: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """step(docs), with all columns but the known ones under names that clash
    with none of the step's own."""
    names = {c: f"__kept{k}" for k, c in enumerate(docs.columns) if c not in known}
    out = step(docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def ranked(df: DataFrame, key: list[str], order: list[str | Column], out: str, spread: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds out: a gapless number from 0 within key, in the order of spread parts.

    Rows of a key are first dealt to parts by spread (a whole number below
    parts; a hash of order by default) and numbered there; the parts' counts,
    a few numbers a key, give each part its offset. No key is ever sorted in
    one task.
    """
    spark = df.sparkSession
    parts = parts or 4 * slices(spark)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = F.pmod(F.xxhash64(*cols), F.lit(parts)) if spread is None else spread
    part, within, before = f"__{out}_part", f"__{out}_in", f"__{out}_before"
    dealt = df.withColumn(part, spread.cast("int"))
    counts = dealt.groupBy(*key, part).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*key).orderBy(part) if key else W.orderBy(part)
    counts = counts.withColumn(before, F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = dealt.withColumn(within, F.row_number().over(W.partitionBy(*key, part).orderBy(*cols)) - 1)
    same = [numbered[k].eqNullSafe(counts[k]) for k in [*key, part]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = numbered.join(counts, on, "left").select(*[numbered[c] for c in numbered.columns], counts[before])
    return joined.withColumn(out, (F.col(within) + F.col(before)).cast("long")).drop(part, within, before)
