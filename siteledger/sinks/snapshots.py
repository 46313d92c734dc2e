"""Daily snapshots with atomic upserts.

A table is a folder with data of commits, partitioned by date, and pointers: version
n of the table is a small table of one row a day that says which commit holds it. An
upsert reads the days it touches, writes them anew as a commit of its own, then a
pointer aside, and renames that to version n + 1. The rename succeeds for one
writer only; another that read version n finds its name taken, and starts again from
the new version. A writer that is lost before its rename has changed nothing.
Readers go on with the version they began with; data of old versions are removed
later by `vacuum`.

    table/data/commit=<id>/date=<day>/…    table/pointers/version=<n>/…    table/pending/<id>
"""

from __future__ import annotations

import os
import uuid
from functools import reduce
from operator import and_
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_POINTER = "day string, commit string"
#: Versions that vacuum keeps, and how long data without a pointer are left alone.
KEEP, YOUNG_SECONDS = 3, 86_400


def _hadoop(spark: SparkSession, path: str):
    """The path for Hadoop, its file system, and the classes beside it. Renames and
    removals have no form in Spark's own API; all else here is DataFrames."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), fs


def _claimed(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder to a name that must be free; whether it was."""
    if urlparse(target).scheme in ("", "file"):
        try:
            os.rename(unquote(urlparse(source).path), unquote(urlparse(target).path))
            return True
        except OSError:
            if os.path.isdir(unquote(urlparse(target).path)):
                return False
            raise
    src, _, fs = _hadoop(spark, source)
    dst = fs.Path(target)
    context = fs.FileContext.getFileContext(dst.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(src, dst, options)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


class SnapshotTable:
    """A table partitioned by date at path, whose rows have the given schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        _, fs, hadoop = _hadoop(spark, self.path)
        for name in ("data", "pointers", "pending"):
            fs.mkdirs(hadoop.Path(f"{self.path}/{name}"))

    def version(self) -> int:
        """The newest version, 0 before the first upsert."""
        folder, fs, _ = _hadoop(self.spark, f"{self.path}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)

    def _days(self, version: int) -> dict[str, str]:
        """The commit that holds each day, a row a day."""
        if not version:
            return {}
        rows = self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointers/version={version}")
        return {r.day: r.commit for r in rows.collect()}

    def _read(self, days: dict[str, str]) -> DataFrame:
        if not days:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/commit={c}/date={d}" for d, c in sorted(days.items())]
        rows = self.spark.read.schema(f"{self.schema}, commit string").option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*self.spark.createDataFrame([], self.schema).columns)

    def read(self, first: str | None = None, last: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of all days, or of those from first to last (ISO dates); folders of
        other days are not even listed."""
        days = self._days(self.version() if version is None else version)
        if first is not None or last is not None:
            days = {d: c for d, c in days.items() if d != _NO_DAY and (first or "") <= d <= (last or "9999-12-31")}
        return self._read(days)

    def upsert(self, rows: DataFrame, keys: list[str], arrival: list[str] | None = None) -> int:
        """Puts rows in place of those with the same keys; the new version. Of rows
        with one key the last in the order of the arrival columns wins, which are not
        stored; without them the largest row does. Rows without a date are a day of
        their own. No row: no version."""
        columns = self.spark.createDataFrame([], self.schema).columns
        rest = [c for c in columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(arrival or rest))).alias("x")).select(*keys, "x.*").select(*columns)
        touched = [_NO_DAY if r.date is None else r.date.isoformat() for r in one.select("date").distinct().collect()]  # a row a day
        if not touched:
            return self.version()
        now = one.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        while True:
            version = self.version()
            days = self._days(version)
            old = self._read({d: c for d, c in days.items() if d in touched})
            commit = uuid.uuid4().hex
            merged = old.join(now, same, "left_anti").unionByName(one)
            merged.repartition("date").write.partitionBy("date").parquet(f"{self.path}/data/commit={commit}")
            if self.publish(version, days | dict.fromkeys(touched, commit)):
                return version + 1

    def publish(self, version: int, days: dict[str, str]) -> bool:
        """Makes days the version after the given one; False if another writer was first."""
        aside = f"{self.path}/pending/{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(days.items()), _POINTER).coalesce(1).write.parquet(aside)
        return _claimed(self.spark, aside, f"{self.path}/pointers/version={version + 1}")

    def vacuum(self, keep: int = KEEP, young_seconds: float = YOUNG_SECONDS) -> int:
        """Removes pointers before the last few, and commits and pending pointers that
        none of these names and that are not young; how many."""
        last = self.version()
        live, gone = set(), []
        folder, fs, hadoop = _hadoop(self.spark, f"{self.path}/pointers")
        for status in fs.listStatus(folder):
            number = int(status.getPath().getName().removeprefix("version="))
            if number > last - keep:
                try:
                    live |= set(self._days(number).values())
                except AnalysisException:  # removed by another vacuum meanwhile
                    continue
            else:
                gone.append(status)
        before = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - young_seconds * 1000
        for name in ("data", "pending"):
            for status in fs.listStatus(hadoop.Path(f"{self.path}/{name}")):
                if status.getPath().getName().removeprefix("commit=") not in live and status.getModificationTime() <= before:
                    gone.append(status)
        return sum(bool(fs.delete(s.getPath(), True)) for s in gone)
