"""Similar articles: near-duplicate pairs, link suggestions, incremental embedding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from siteledger.functions.scalars import content_hash, dot, link_key, unit
from siteledger.sources.shared import kept

NEAR_DUPLICATE, FLOOR, TOP = 0.92, 0.35, 5
#: Vectors in a block of the blocked join, and bytes of them: a bigger block means
#: fewer copies of each vector, its bytes bound what a task holds. Tables of few
#: blocks are cut finer, down to LEAST_ROWS, so that each core has PAIRS_A_CORE pairs
#: of blocks.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS, PAIRS_A_CORE = 65_536, 32_000_000, 2048, 4
#: Rows and columns of the products that a task holds at once, and pairs of a batch
#: that it gives back.
TILE, SENT = (256, 8192), 100_000
#: So few blocks all meet each other: no plan would save what it costs.
FEW_BLOCKS = 8
#: Centers of balls at most, sampled vectors a center and their bytes, rings of a
#: ball, and the angle that covers rounding.
CENTERS, SAMPLE, SAMPLE_BYTES, RINGS, MARGIN = 4096, 8, 64_000_000, 64, 1e-6
#: Characters of texts that are cut into words at once: words take many times their letters.
EMBEDDED_CHARS = 500_000
#: Buckets of slugs by which known articles are read.
SLUG_BUCKETS = 1 << 18


def _units(articles: DataFrame) -> DataFrame:
    """slug and unit vector; vectors that are null or of length 0, and those without
    a slug, match nothing."""
    return articles.select("slug", unit(F.col("embedding")).alias("v")).filter("v is not null and slug is not null")


def naive_pairs(articles: DataFrame, at_least: float) -> DataFrame:
    """slug_a < slug_b with cosine >= at_least, pair by pair: for small tables."""
    u = _units(articles)
    a, b = u.select(F.col("slug").alias("slug_a"), F.col("v").alias("va")), u.select(F.col("slug").alias("slug_b"), F.col("v").alias("vb"))
    return a.join(b, F.col("slug_a") < F.col("slug_b")).withColumn("similarity", dot(F.col("va"), F.col("vb"))).filter(F.col("similarity") >= at_least).select("slug_a", "slug_b", "similarity")


@dataclass
class Balls:
    """Blocks of vectors: each is a ring around one of the centers, from one angle
    to another; a ring with too many vectors is several blocks."""

    centers: np.ndarray  # a row a center
    ball: np.ndarray  # of each block
    low: np.ndarray
    high: np.ndarray

    def apart(self, v: np.ndarray) -> np.ndarray:
        """The least angle that each vector can have to any vector of each block: by
        the triangle inequality, over the center of the block."""
        to = np.arccos(np.clip(v @ self.centers.T, -1, 1))[:, self.ball]
        return np.maximum(np.maximum(self.low - to, to - self.high), 0)


def _centers(u: DataFrame, n: int, dims: int) -> np.ndarray:
    """n directions that follow the vectors: means of groups of a sample."""
    size = max(n, min(SAMPLE * n, SAMPLE_BYTES // (8 * dims)))
    sample = np.stack([np.asarray(r.v) for r in u.orderBy(F.xxhash64("slug")).limit(size).select("v").collect()])  # bounded
    centers = sample[:n]
    for _ in range(3):
        near = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers)
    return centers


def _in_balls(articles: DataFrame, blocks: int, rows: int) -> tuple[DataFrame, Balls]:
    """slug, v and block of each vector that is not 0, stored, and the blocks. A
    vector belongs to its nearest center; around it, to a ring of RINGS, or of
    several together while they have few vectors."""
    spark = articles.sparkSession
    u = _units(articles)
    dims = u.select(F.size("v")).first()
    centers = _centers(u, min(blocks, CENTERS), dims[0]) if dims else np.zeros((1, 1))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = np.stack(f["v"].to_list()) @ centers.T if len(f) else np.zeros((0, 1))
            yield f.assign(ball=np.argmax(s, axis=1).astype("int32"), angle=np.arccos(np.clip(s.max(axis=1), -1, 1)))

    dealt = kept(u.mapInPandas(nearest, "slug string, v array<double>, ball int, angle double").withColumn("ring", F.least(F.floor(F.col("angle") / math.pi * RINGS), F.lit(RINGS - 1)).cast("int")), "balls")
    rings = dealt.groupBy("ball", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("ball", "ring").collect()  # a row a ring
    found: list[list] = []  # ball, rings, low, high, vectors
    for r in rings:
        if found and found[-1][0] == r.ball and found[-1][4] + r.n <= rows:
            found[-1][1].append(r.ring)
            found[-1][3:] = [r.high, found[-1][4] + r.n]
        else:
            found.append([r.ball, [r.ring], r.low, r.high, r.n])
    places, ball, low, high = [], [], [], []
    for b, ring, lo, hi, n in found:
        parts = -(-n // rows)
        places += [(b, x, len(ball), parts) for x in ring]
        ball += [b] * parts
        low += [lo - MARGIN] * parts
        high += [hi + MARGIN] * parts
    placed = spark.createDataFrame(places, "ball int, ring int, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("slug"), F.col("parts")).cast("int")
    return dealt.join(F.broadcast(placed), ["ball", "ring"]).select("slug", "v", block.alias("block")), Balls(centers, np.array(ball, int), np.array(low), np.array(high))  # a row a ring


def _met(u: DataFrame, reach: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """(block, other, slug, v, …) for every other block that a vector may have a
    match in; reach tells which, a row a vector and a column a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 512):
                part = f.iloc[k : k + 512]
                row, other = np.nonzero(reach(part, np.stack(part["v"].to_list())))
                yield part.iloc[row].assign(other=other.astype("int32"))

    return u.mapInPandas(run, StructType([*u.schema.fields, StructField("other", IntegerType())]))


def _all_met(articles: DataFrame, blocks: int) -> DataFrame:
    """Vectors dealt to blocks by a hash, and each block to each other."""
    u = _units(articles).withColumn("block", F.pmod(F.xxhash64("slug"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return u.withColumn("o", other).select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "slug", "v")


def dealt_pairs(articles: DataFrame, at_least: float, blocks: int | None = None) -> DataFrame:
    """Vectors dealt to pairs of blocks (i, j): a vector goes to its own block and to
    those where a match with cosine at_least is possible; to all of a few."""
    rows, blocks = _layout(articles, blocks)
    if blocks < FEW_BLOCKS:
        return _all_met(articles, blocks)
    u, balls = _in_balls(articles, blocks, rows)
    widest = math.acos(max(-1.0, min(1.0, at_least))) + MARGIN

    def reach(f: pd.DataFrame, v: np.ndarray) -> np.ndarray:
        out = balls.apart(v) <= widest
        out[np.arange(len(f)), f["block"].to_numpy()] = True
        return out

    return _met(u, reach).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "slug", "v")


def products(dealt: DataFrame) -> DataFrame:
    """One row: how many pairs of vectors the pairs of blocks multiply."""
    a, b = F.count_if(F.col("block") == F.col("i")), F.count_if(F.col("block") == F.col("j"))
    per = dealt.groupBy("i", "j").agg(F.when(F.col("i") == F.col("j"), a * (a - 1) / 2).otherwise(a * b).alias("n"))
    return per.agg(F.sum("n").cast("long").alias("products"))


def _layout(articles: DataFrame, blocks: int | None = None) -> tuple[int, int]:
    """Most vectors of a block, and how many blocks: as few as their size allows, but
    enough for PAIRS_A_CORE pairs a core, or a pair a shuffle partition if that is less."""
    spark = articles.sparkSession
    size = articles.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dims")).first()
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size.dims, 1))))
    if blocks is None:
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PAIRS_A_CORE * spark.sparkContext.defaultParallelism)
        blocks = max(1, -(-size.n // rows), min(-(-size.n // LEAST_ROWS), math.ceil(math.sqrt(2 * tasks))))
    return rows, blocks


_PAIR = ("slug_a", "slug_b", "similarity")
_PAIRS = "slug_a string, slug_b string, similarity double"


@dataclass
class Block:
    """Vectors of a block: slugs, their ranks among all slugs that a task holds, and
    unit vectors, also rounded to single precision."""

    slugs: pa.Array
    rank: np.ndarray
    v: np.ndarray
    rough: np.ndarray

    def where(self, mask: np.ndarray) -> Block:
        at = np.flatnonzero(mask)
        return Block(self.slugs.take(pa.array(at)), self.rank[at], self.v[at], self.rough[at])

    def is_source(self) -> np.ndarray:
        return pc.match_substring(self.slugs, "/").to_numpy(zero_copy_only=False)


def _block(slugs: pa.Array, lists: pa.Array) -> Block:
    sizes = pc.list_value_length(lists).unique()
    if len(sizes) > 1:
        raise ValueError(f"vectors differ in their dimensions: {sorted(sizes.to_pylist())}")
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(slugs), -1)
    rank = pc.rank(slugs, tiebreaker="dense").to_numpy().astype(np.int64)
    return Block(slugs, rank, v, v.astype(np.float32))


def _two_blocks(batches: Iterator[pa.RecordBatch], i: int, j: int) -> tuple[Block, Block]:
    """The blocks i and j of dealt rows (i, j, block, slug, v)."""
    table = pa.Table.from_batches(list(batches)).select(["block", "slug", "v"])
    block = table["block"].to_numpy()
    both = _block(table["slug"].combine_chunks(), table["v"].combine_chunks())
    return both.where(block == i), (both.where(block == j) if i != j else both)


def _room(a: Block) -> float:
    """What rounding to single precision can change a product of unit vectors by."""
    return (a.v.shape[1] + 8) * 1.2e-7


def _sent(a: pa.Array, b: pa.Array, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(s), SENT):
        yield pa.RecordBatch.from_arrays([a[k : k + SENT], b[k : k + SENT], pa.array(s[k : k + SENT])], names=list(_PAIR))


def near_duplicate_pairs(articles: DataFrame, at_least: float = NEAR_DUPLICATE, blocks: int | None = None) -> DataFrame:
    """slug_a < slug_b with cosine >= at_least: exact, by products of blocks that
    can hold a pair. Products in single precision find the pairs that may reach it,
    those in double precision decide; a tile's pairs are given back before the next."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        a, b = _two_blocks(batches, i, j)
        floor = at_least - _room(a)
        for k in range(0, len(a.rank), TILE[0]):
            for c in range(0, len(b.rank), TILE[1]):
                m = a.rough[k : k + TILE[0]] @ b.rough[c : c + TILE[1]].T
                x, y = np.divmod(np.flatnonzero(m >= floor), m.shape[1])
                x, y = x + k, y + c
                apart = a.rank[x] < b.rank[y] if i == j else a.rank[x] != b.rank[y]
                x, y = x[apart], y[apart]
                for n in range(0, len(x), SENT):
                    p, q = x[n : n + SENT], y[n : n + SENT]
                    s = np.einsum("ij,ij->i", a.v[p], b.v[q])
                    p, q, s = p[s >= at_least], q[s >= at_least], s[s >= at_least]
                    first = pa.array(a.rank[p] < b.rank[q])
                    of_a, of_b = a.slugs.take(pa.array(p)), b.slugs.take(pa.array(q))
                    yield from _sent(pc.if_else(first, of_a, of_b), pc.if_else(first, of_b, of_a), s)

    return dealt_pairs(articles, at_least, blocks).groupBy("i", "j").applyInArrow(run, _PAIRS)


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs from the most similar on; ties by slug."""
    return pairs.orderBy(F.desc(F.rint(F.col("similarity") * 1e9)), "slug_a", "slug_b")


def _best(a: Block, b: Block, top: int, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best targets in b of each source in a, in runs of (places in a, places in b,
    similarities); sums that tie once rounded go by slug.

    Products in single precision leave out what cannot be among a source's best, given
    at_least and what it has found so far; those in double precision rank the others."""
    room = _room(a) + 2e-9
    alike = int(np.bincount(b.rank).max()) if len(b.rank) else 0  # targets with one slug at most
    for k in range(0, len(a.rank) if len(b.rank) else 0, TILE[0]):
        rank, rough = a.rank[k : k + TILE[0]], a.rough[k : k + TILE[0]]
        floor = np.full(len(rank), max(at_least, -2.0) - room, np.float32)
        x, y, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for c in range(0, len(b.rank), TILE[1]):
            m = rough @ b.rough[c : c + TILE[1]].T
            hit = m >= floor[:, None]
            last = m.shape[1] - top - alike  # the source itself, too, may be among the products
            if last > 0 and np.count_nonzero(hit) > 64 * len(rank):
                hit &= m >= np.partition(np.where(hit, m, -np.inf), last, axis=1)[:, last, None] - 2 * room
            p, q = np.divmod(np.flatnonzero(hit), m.shape[1])
            q = q + c
            other = rank[p] != b.rank[q]
            p, q = p[other], q[other]
            if not len(p):
                continue
            t = np.concatenate([np.einsum("ij,ij->i", a.v[k + p[n : n + SENT]], b.v[q[n : n + SENT]]) for n in range(0, len(p), SENT)])
            good = t >= at_least
            x, y, s = np.append(x, p[good]), np.append(y, q[good]), np.append(s, t[good])
            order = np.lexsort((b.rank[y], -np.rint(s * 1e9), x))
            x, y, s = x[order], y[order], s[order]
            nth = np.arange(len(x)) - np.searchsorted(x, x, side="left")
            full = nth == top - 1
            floor[x[full]] = np.maximum(floor[x[full]], s[full] - room)
            x, y, s = x[nth < top], y[nth < top], s[nth < top]
        if len(x):
            yield k + x, y, s


def dealt_sources(articles: DataFrame, top: int, at_least: float, rows: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Best targets within each source's own block (schema of pairs), and sources and
    targets dealt to pairs of other blocks (i of the source, j of the target).

    What a source has found at home is its threshold: it goes only to blocks that
    can hold something as good as its last, and targets only to blocks with a
    source that they can be good enough for."""
    u, balls = _in_balls(articles, blocks, rows)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).select(["slug", "v", "block"]).combine_chunks()
        slug, v, block = (table.column(c).chunk(0) for c in range(3))
        b = _block(slug, v)
        at = np.flatnonzero(b.is_source())
        runs = [(at[x], y, s) for x, y, s in _best(b.where(b.is_source()), b, top, at_least)]
        x, y, s = (np.concatenate([r[k] for r in runs]) for k in range(3)) if runs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        n = np.bincount(x, minlength=len(slug))
        starts = np.append(0, np.cumsum(n)).astype(np.int32)
        goal = np.full(len(slug), float(at_least))
        goal[n >= top] = s[starts[1:][n >= top] - 1]  # the last of a full list
        targets = pa.ListArray.from_arrays(pa.array(starts), slug.take(pa.array(y)))
        found = pa.ListArray.from_arrays(pa.array(starts), pa.array(s))
        for batch in pa.Table.from_arrays([slug, v, block, targets, found, pa.array(goal)], names=["slug", "v", "block", "targets", "found", "goal"]).to_batches(SENT):
            yield batch

    homes = kept(u.groupBy("block").applyInArrow(home, "slug string, v array<double>, block int, targets array<string>, found array<double>, goal double"), "homes")
    is_source = F.contains("slug", F.lit("/"))
    lowest = np.full(len(balls.ball), np.inf)
    for r in homes.filter(is_source).groupBy("block").agg(F.min("goal").alias("goal")).collect():  # a number a block
        lowest[r.block] = r.goal

    def good(apart: np.ndarray, goal: np.ndarray) -> np.ndarray:
        return np.cos(apart) >= goal - 2e-9

    def away(f: pd.DataFrame, out: np.ndarray) -> np.ndarray:
        out[np.arange(len(f)), f["block"].to_numpy()] = False
        return out

    asking = _met(homes.filter(is_source).select("slug", "v", "block", "goal"), lambda f, v: away(f, good(balls.apart(v), f["goal"].to_numpy()[:, None])))
    asked = _met(u, lambda f, v: away(f, good(balls.apart(v), lowest[None, :])))
    both = asking.select(F.col("block").alias("i"), F.col("other").alias("j"), "block", "slug", "v").union(asked.select(F.col("other").alias("i"), F.col("block").alias("j"), "block", "slug", "v"))
    at_home = homes.select(F.col("slug").alias("slug_a"), F.explode(F.arrays_zip("targets", "found")).alias("x")).select("slug_a", F.col("x.targets").alias("slug_b"), F.col("x.found").alias("similarity"))
    return at_home, both


def top_similar(articles: DataFrame, top: int = TOP, blocks: int | None = None, at_least: float = -2.0) -> DataFrame:
    """source_slug, target_slug, similarity, rank: each article's most similar
    others, at_least so similar; ties by slug. Only slugs with a / are sources."""
    rows, blocks = _layout(articles, blocks)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        a, b = _two_blocks(batches, i, j)
        for p, q in ((a, b), (b, a)) if both_ways and i != j else ((a, b),):
            sources = p.where(p.is_source())
            for x, y, s in _best(sources, q, top, at_least):
                yield from _sent(sources.slugs.take(pa.array(x)), q.slugs.take(pa.array(y)), s)

    both_ways = blocks < FEW_BLOCKS
    if both_ways:
        pairs = _all_met(articles, blocks).groupBy("i", "j").applyInArrow(run, _PAIRS)
    else:
        at_home, both = dealt_sources(articles, top, at_least, rows, blocks)
        pairs = at_home.union(both.groupBy("i", "j").applyInArrow(run, _PAIRS))
    pairs = pairs.withColumnsRenamed({"slug_a": "source_slug", "slug_b": "target_slug"})
    w = W.partitionBy("source_slug").orderBy(F.desc(F.rint(F.col("similarity") * 1e9)), "target_slug")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def suggestions(pairs: DataFrame, existing: DataFrame | None = None, floor: float = FLOOR) -> DataFrame:
    """stable_key, source_slug, target_slug, similarity of top_similar's pairs at or
    above the floor, without those in existing; what is taken away is not filled up."""
    pairs = pairs.filter(F.col("similarity") >= floor).drop("rank")
    if existing is not None:
        pairs = pairs.join(existing, ["source_slug", "target_slug"], "left_anti")
    return pairs.select(link_key("source_slug", "target_slug").alias("stable_key"), "source_slug", "target_slug", "similarity")


def link_suggestions(articles: DataFrame, existing: DataFrame | None = None, top: int = TOP, floor: float = FLOOR, blocks: int | None = None) -> DataFrame:
    """suggestions of the articles' top pairs."""
    return suggestions(top_similar(articles, top, blocks, floor), existing, floor)


def with_slugs_of(known: DataFrame, articles: DataFrame, buckets: int = SLUG_BUCKETS) -> DataFrame:
    """The rows of known that may have a slug of articles: those whose hash falls in
    a bucket that one of articles falls in. The buckets hit, buckets numbers at
    most, go to every task, so the other rows are dropped where they are read and
    never reach a shuffle."""
    bucket = F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int").alias("__bucket")
    hit = articles.select(bucket).distinct()
    return known.select("*", bucket).join(F.broadcast(hit), "__bucket", "left_semi").drop("__bucket")


def change_set(articles: DataFrame, known: DataFrame) -> DataFrame:
    """slug, content_hash and action of articles (slug, text): new, changed or unchanged."""
    now = articles.select("slug", content_hash("text").alias("content_hash"))
    was = with_slugs_of(known.select("slug", F.col("content_hash").alias("__old")), articles)
    action = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return now.join(was, "slug", "left").select("slug", "content_hash", action.alias("action"))


def refresh_counts(articles: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many articles a refresh embeds, skips, and cannot read (null text)."""
    actions = change_set(articles.filter("text is not null"), known)
    failed = articles.agg(F.count_if(F.col("text").isNull()).alias("failed"))
    counts = actions.agg(F.count_if(F.col("action") != "unchanged").alias("embedded"), F.count_if(F.col("action") == "unchanged").alias("skipped"))
    return counts.crossJoin(failed)  # one row each


def hashing_embedder(dims: int = 256) -> Callable[[Column], Column]:
    """The default embedder: counts of hashed words, at length 1; no model needed."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        text = text.fillna("").reset_index(drop=True)
        out = np.zeros((len(text), dims), np.float32)
        piece = text.str.len().cumsum() // EMBEDDED_CHARS
        for _, some in text.groupby(piece, sort=False):
            flat = some.str.lower().str.findall(r"\w+").explode().dropna()
            slots = pd.util.hash_array(flat.to_numpy(object)) % np.uint64(dims)
            np.add.at(out, (flat.index.to_numpy(np.int64), slots.astype(np.int64)), 1)
        return pd.Series(list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)))

    return embed


def refresh_embeddings(articles: DataFrame, known: DataFrame, embed: Callable[[Column], Column], now) -> DataFrame:
    """known (schemas.ARTICLE) after a run over articles (slug, url, text): new and
    changed texts are embedded; a changed row keeps its url; rows of articles
    that are gone stay. Articles that could not be fetched (null text) are left
    as they are."""
    from siteledger.operators.ledger import upsert

    todo = articles.filter("text is not null").join(change_set(articles.filter("text is not null"), known).filter("action <> 'unchanged'"), "slug")
    fresh = todo.select("slug", "url", "content_hash", embed(F.col("text")).alias("embedding"), F.lit(now).cast("timestamp").alias("updated_at"))
    return upsert(known, fresh, ["slug"], keep=["url"])
