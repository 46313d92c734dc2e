"""Quality rules with robust multivariate outliers (operator 10).

Every text gets a few statistics. Two plain rules reject texts outright; the
rest are judged, per language and source, by a minimum-covariance-determinant
(MCD) estimate. A concentration step keeps the SUPPORT share of a group's rows
that lie closest to the current centre and re-estimates centre and covariance
from them, which never makes the determinant larger. Each group starts from
three centres (its quartiles); after a few steps the start with the least
determinant goes on. Rows whose robust Mahalanobis distance is beyond a
chi-square limit are rejected.

A group's estimate is drawn towards what the groups have in common (the pooled
scatter within groups and the mean of all kept rows) with the weight of
PRIOR_ROWS rows. So a group of any size has an estimate of its own, and a few odd
rows of a small group are judged by what is usual elsewhere.

All sums run as grouped Spark aggregations: no group is ever gathered. A step is
one pass: sums by group and narrow class of distance give both which classes are
the closest and what is in them. Counts decide, so reruns keep the same rows.

Defined cases: a null text counts as empty (all statistics 0, rejected by the
word rule); null language or source form their own group; repeated ids are
judged row by row; a very long text is one row like any other; an empty table
gives an empty result; extra columns pass through `reject_outliers` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from siteledger.llm.common import sheltered, stored
from siteledger.llm.textops import STEP_BYTES, WHITESPACE, span_hashes, spans, texts, windows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: So many rows' weight has what the groups have in common in a group's estimate.
PRIOR_ROWS = 20
#: Starts are centres at these quantiles of each statistic. All of them take
#: TRIAL_STEPS concentration steps, the best one LAST_STEPS more.
STARTS = (0.25, 0.5, 0.75)
TRIAL_STEPS = 2
LAST_STEPS = 3
SUPPORT = 0.75
#: Classes of squared distance: so many to a doubling, between two limits.
CLASSES = 16
LEAST, MOST = 2.0**-8, 2.0**16
#: 0.99999 quantile of chi-square with 5 degrees of freedom, and the factor
#: that makes a 75 % support covariance consistent under normality.
CUTOFF = 30.86
CONSISTENCY = 1.45
#: Least standard deviation of each transformed statistic: keeps a statistic
#: that is constant in most rows from rejecting every row that has it.
FLOORS = (0.45, 0.2, 0.35, 0.5, 0.6)
#: Up to so many groups, their estimates (a few numbers each) are broadcast, so
#: that rows of a big group stay where they are.
BROADCAST_GROUPS = 10_000
DIMS = ("z0", "z1", "z2", "z3", "z4")

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINE_BREAK = np.zeros(256, dtype=bool)
_LINE_BREAK[0x0A] = True
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _later_copies(owner: np.ndarray, hashes: np.ndarray, all_of_them: bool) -> np.ndarray:
    """Which entries equal an earlier one of their text (or any other one)."""
    hit = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 2:
        return hit
    order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)), kind="stable")
    o, h = owner[order], hashes[order]
    same = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    hit[order[1:][same]] = True
    if all_of_them:
        hit[order[:-1][same]] = True
    return hit


def text_statistics(column: pa.Array) -> list[np.ndarray]:
    """The five statistics of each text of an Arrow string column."""
    out = [np.zeros(len(column), dtype=np.int64) for _ in range(5)]
    for t in texts(column, STEP_BYTES):
        at, n = slice(t.first, t.first + len(t)), len(t)
        if not len(t.data):
            continue
        starts, ends, owner = spans(t)
        out[0][at] = np.bincount(owner, minlength=n)
        chars = np.concatenate([[0], np.cumsum(~WHITESPACE[t.data] & ((t.data & 0xC0) != 0x80))])
        out[1][at] = np.diff(chars[t.offsets])
        out[2][at] = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])[t.offsets])
        ls, le, lo = spans(t, _LINE_BREAK)
        words_before = np.searchsorted(starts, ls)
        worded = (words_before < len(starts)) & (np.append(starts, len(t.data))[words_before] < le)
        dup = _later_copies(lo[worded], span_hashes(t, ls, le, False)[worded], False)
        out[3][at] = np.bincount(lo[worded][dup], minlength=n)
        runs, first = windows(span_hashes(t, starts, ends, False), owner, WINDOW)
        first = first[_later_copies(owner[first], runs, True)]
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + WINDOW, -1)
        out[4][at] = np.bincount(owner, weights=np.cumsum(cover)[:-1] > 0, minlength=n)
    return out


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and the statistics of the text, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = text_statistics(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, stats)], names=[*keep, *names])

    names = STATS
    kept = docs.select(*keep, text)
    return kept.mapInArrow(run, StructType(kept.schema.fields[:-1] + [StructField(x, LongType()) for x in names]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _transformed(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "z0": F.log1p(F.col("n_words").cast("double")),
        "z1": F.log1p(F.col("word_chars") / n),
        "z2": F.asinh(100.0 * F.col("n_symbols") / n),
        "z3": F.log1p(F.col("n_dup_lines").cast("double")),
        "z4": F.asinh(20.0 * F.col("n_repeat_words") / n),
    })


PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i:]]


def _sums(values: dict[str, Column]) -> list[Column]:
    return [F.sum(c).alias(name) for name, c in values.items()]


def _quartiles(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, and the three quartiles of each statistic, exact to two digits."""
    cuts = [F.percentile(F.round(z, 2), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias(z) for z in DIMS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cuts)


def _starts(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row a group and start: centre, and the inverse of a diagonal covariance
    from the spread between quartiles; both drawn towards those of all rows."""
    every = _quartiles(rows, []).first()  # 16 numbers
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mixed = {z: [F.col(z)[k] * share + float(every[z][k] if every[z] else 0.0) * (1 - share) for k in range(3)] for z in DIMS}
    spread = [F.greatest((mixed[z][2] - mixed[z][0]) / 1.349, F.lit(FLOORS[i])) for i, z in enumerate(DIMS)]
    size = len(DIMS)
    inverse = F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(size) for j in range(size)])
    centres = F.array(*[F.array(*[mixed[z][k] for z in DIMS]) for k in range(len(STARTS))])
    return _quartiles(rows, by).select(*by, inverse.alias("inverse"), F.posexplode(centres).alias("start", "centre"))


def _distance(start: int) -> Column:
    size = len(DIMS)
    d = [F.col(z) - F.col("centres")[start][i] for i, z in enumerate(DIMS)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col("inverses")[start][i * size + j] for i in range(size) for j in range(i, size)]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def _by_group(estimates: DataFrame, by: list[str]) -> DataFrame:
    """centres and inverses of each group in order of starts; stored, and marked
    for broadcast if there are few groups."""
    one = F.struct("start", "centre", "inverse")
    table = estimates.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("x")).select(*by, F.col("x.centre").alias("centres"), F.col("x.inverse").alias("inverses"))
    table = stored(table, "outliers-estimates")
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _closest(rows: DataFrame, estimates: DataFrame, by: list[str], starts: int) -> DataFrame:
    """Sums over the closest SUPPORT of each group, for each start: n, sums and
    sums of products of the statistics."""
    met = rows.join(_by_group(estimates, by), by)
    each = met.select(*by, *DIMS, F.posexplode(F.array(*[_distance(k) for k in range(starts)])).alias("start", "distance"))
    near = F.least(F.greatest(F.col("distance"), F.lit(LEAST)), F.lit(MOST))
    values = {"n": F.lit(1)} | {f"s_{z}": F.col(z) for z in DIMS} | {f"p_{a}{b}": F.col(a) * F.col(b) for a, b in PAIRS}
    classes = each.groupBy(*by, "start", F.floor(F.log2(near) * CLASSES).cast("int").alias("class")).agg(*_sums(values))
    group = W.partitionBy(*by, "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = classes.withColumn("before", before).withColumn("all", F.sum("n").over(group)).filter(F.col("before") < SUPPORT * F.col("all"))
    return stored(some.groupBy(*by, "start").agg(*_sums({c: F.col(c) for c in values})), "outliers-sums")


def _estimates(sums: DataFrame, by: list[str]) -> DataFrame:
    """centre, inverse covariance and log determinant of each group and start,
    from its sums (one row in, one out), drawn towards the pooled ones."""
    import pandas as pd

    size = len(DIMS)
    scatter = {f"p_{a}{b}": F.col(f"p_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") for a, b in PAIRS}
    pooled = {r.start: r for r in sums.groupBy("start").agg(*_sums({"n": F.col("n")} | {f"s_{z}": F.col(f"s_{z}") for z in DIMS} | scatter)).collect()}  # a row a start

    def matrix(row, start: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), size, size))
        for i, a in enumerate(DIMS):
            for j in range(i, size):
                out[:, i, j] = out[:, j, i] = row(f"p_{a}{DIMS[j]}")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            start = f["start"].to_numpy()
            all_ = lambda c: np.array([float(pooled[k][c]) for k in start])
            n, n_all = f["n"].to_numpy(float), all_("n")
            own = np.stack([f[f"s_{z}"].to_numpy(float) for z in DIMS], 1)
            usual = np.stack([all_(f"s_{z}") for z in DIMS], 1) / n_all[:, None]
            weight = (n + PRIOR_ROWS)[:, None]
            centre = (own + PRIOR_ROWS * usual) / weight
            mine = matrix(lambda c: f[c].to_numpy(float), start) - own[:, :, None] * own[:, None, :] / n[:, None, None]
            cov = (mine + PRIOR_ROWS * matrix(all_, start) / n_all[:, None, None]) / weight[:, :, None] * CONSISTENCY
            floor = np.asarray(FLOORS) ** 2
            short = np.maximum(floor - np.einsum("nii->ni", cov), 0)
            cov[:, range(size), range(size)] += short + 1e-3 * floor
            inverse = np.linalg.inv(cov) if len(f) else cov
            log_det = np.linalg.slogdet(cov)[1] if len(f) else np.zeros(0)
            yield pd.DataFrame({**{c: f[c] for c in by}, "start": start, "centre": list(centre), "inverse": list(inverse.reshape(len(f), size * size)), "log_det": log_det})

    array = ArrayType(DoubleType())
    fields = [sums.schema[c] for c in by] + [StructField("start", IntegerType()), StructField("centre", array), StructField("inverse", array), StructField("log_det", DoubleType())]
    return sums.mapInPandas(run, StructType(fields))


def with_distance(stats: DataFrame, by: list[str]) -> DataFrame:
    """Adds distance, the squared robust distance of each row of its group's centre.

    by: columns that hold no nulls."""
    rows = stored(_transformed(stats), "outliers-rows")
    est = _starts(rows, by)
    for _ in range(TRIAL_STEPS):
        est = _estimates(_closest(rows, est, by, len(STARTS)), by)
    # The start with the least determinant; of equal ones the first.
    est = est.groupBy(*by).agg(F.min_by(F.struct("centre", "inverse"), F.struct(F.round("log_det", 9), "start")).alias("x")).select(*by, F.lit(0).alias("start"), "x.*")
    for _ in range(LAST_STEPS):
        est = _estimates(_closest(rows, est, by, 1), by)
    return rows.join(_by_group(est, by), by).withColumn("distance", _distance(0)).drop("centres", "inverses", *DIMS)


def _group_column(name: str) -> Column:
    return F.coalesce(name, F.lit("\x00"))


def _row() -> Column:
    """A hash of all that a row's verdict depends on, and of its id."""
    return F.xxhash64("doc_id", "text", _group_column("lang"), _group_column("source"))


def _judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """judge_documents with the columns in keep in place of doc_id."""
    stats = with_statistics(docs.select(*keep, _group_column("lang").alias("lang"), _group_column("source").alias("source"), "text"), [*keep, "lang", "source"])
    stats = stored(stats.withColumn("base_failed", base_failed()), "outliers-stats")
    passed = with_distance(stats.filter(~F.col("base_failed")), ["lang", "source"])
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    out = passed.unionByName(failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF)).drop("lang", "source")


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null if the base rules
    reject) and kept, for every row of docs."""
    return _judged(docs, ["doc_id"])


def reject_outliers(docs: DataFrame) -> DataFrame:
    """docs without the rows that judge_documents rejects, row by row: rows with
    the same id stand for themselves; all columns stay."""

    def step(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("__row", _row())
        rejected = _judged(keyed, ["__row"]).filter(~F.col("kept")).select("__row").distinct()
        return keyed.join(rejected, "__row", "left_anti").drop("__row")

    return sheltered(docs, step, ("doc_id", "text", "lang", "source"))


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))
