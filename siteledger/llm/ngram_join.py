"""N-gram Jaccard join by vertical partitioning (operator 1).

A document is the set of its distinct word n-grams, as 48-bit hashes. Two
documents link if 100 * |A & B| >= percent * |A | B|.

1. Documents that cannot link leave. Of a third of all n-grams (those with the
   smallest hashes) it is counted how many occur in no other document; such an
   n-gram is in no intersection, so a document with too many of them has no
   partner. N-grams travel as sorted arrays by hash range, one entry a chunk of
   documents and n-gram, so a very common one costs no more than a rare one.
2. Equal sets become one representative. N-grams of representatives get a
   global order, rarest first, and those that only one has leave.
3. Candidates are representatives that share an n-gram of their prefixes: two
   sets that link must share one among their first |A| - ceil(p |A|) + 1.
4. The global order is cut into FRAGMENTS at quantiles. For each candidate pair
   the overlap in each fragment is counted separately, and the counts are
   summed per pair and tested.

A pair is a candidate at a shared n-gram only if what both have from there on
in the order could still make enough overlap; at the first n-gram that a linking
pair shares this always holds. Candidates come in two rounds. The first pairs
each prefix list's documents with one leader of the list, the one with most to
share, which joins big groups of near copies with as many pairs as documents;
the second takes every pair left whose two sides are not yet in one component.
So no link between components is lost.

5. Links are counted: every link lies in one component, so the representatives of
   a component meet each other once more, in blocks, as products of their sets.
   A block gives numbers of links, weighted by how many documents have each set;
   the pairs, which grow with the square of a group, are never written.

Defined cases: a very long text is read whole, alone in its run; null and empty texts, or texts without a word, have the empty
set, no link and their own id as component; a text with fewer than n words has
its whole sequence as single member; rows that share an id and text are one
node; rows that share an id only are separate nodes, and a component is named
by the smallest id in it; an id may be null (it names a component only if no
other id does); n_links counts the other nodes, those with an equal set too, that
a node links to; extra columns are ignored by `near_duplicates` and kept by
`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.common import sheltered, slices, stored
from siteledger.llm.components import components
from siteledger.llm.textops import Texts, mix, span_hashes, spans, texts, windows

FRAGMENTS = 4
#: Bytes of text whose n-grams a task gathers before it sends them on.
CHUNK_BYTES = 12_000_000
#: A document's place in its chunk has 16 bits, of which _MANY is taken.
CHUNK_DOCS = 65_535
#: Sets, and n-grams in them, of a block of the count of links.
BLOCK_SETS = 1024
BLOCK_GRAMS = 1_000_000
#: An n-gram that makes more pairs of a block than this is counted as a column
#: of a matrix product, others pair by pair.
DENSE_PAIRS = 4096
DENSE_COLUMNS = 2048
_LOW48 = np.uint64((1 << 48) - 1)
_THIRD = np.uint64((1 << 48) // 3)
_MANY = np.uint64(0xFFFF)


def ngram_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 48-bit hash of each distinct n-gram, sorted by text and hash."""
    starts, ends, owner = spans(t)
    words = span_hashes(t, starts, ends, True)
    h, first = windows(words, owner, width)
    own = owner[first]
    n = np.bincount(owner, minlength=len(t))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):  # the whole sequence, with its length
        whole = n[short].astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(n)])[short]
        for k in range(width - 1):
            has = n[short] > k
            whole[has] = mix(whole[has] * np.uint64(3) + words[at[has] + k])
        h, own = np.concatenate([h, whole]), np.concatenate([own, short])
    key = np.unique((own.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW48


def _node() -> Column:
    return F.xxhash64("doc_id", "text")


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """node, doc_id, n (size of the set) and alone: how many of the n-grams in
    the counted third no other node has."""
    parts = 2 * slices(docs.sparkSession)
    schema = "bucket int, chunk long, nodes binary, ids binary, known binary, sizes binary, grams binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_chunks = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        bytes_, docs_ = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, bytes_, docs_, n_chunks
            nodes, ids, known, sizes = (np.concatenate([x[k] for x in held]) for k in range(4))
            # As one whole number each: hash, then the document's place in the chunk.
            grams = np.sort(np.concatenate([x[4] for x in held]))
            h = grams >> np.uint64(16)
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(h))) > 1
            grams = grams[at]
            grams[many] |= _MANY
            cut = np.searchsorted(grams >> np.uint64(16), (np.arange(parts + 1) * (int(_THIRD) + 1) // parts).astype(np.uint64))
            rows = [(k, grams[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            chunk = base + n_chunks
            n_chunks += 1
            held, bytes_, docs_ = [], 0, 0
            empty = [None] * len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk % parts, *(r[0] for r in rows)], pa.int32()), pa.array([chunk] * (len(rows) + 1), pa.int64()),
                    *[pa.array([x.tobytes(), *empty], pa.binary()) for x in (nodes, ids, known, sizes)],
                    pa.array([None, *(r[1] for r in rows)], pa.binary()),
                ],
                names=["bucket", "chunk", "nodes", "ids", "known", "sizes", "grams"],
            )

        for b in batches:
            nodes, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy(zero_copy_only=False)
            for t in texts(b.column(2)):
                if held and docs_ + len(t) > CHUNK_DOCS:
                    yield flush()
                own, h = ngram_sets(t, width)
                rows = slice(t.first, t.first + len(t))
                some = h < _THIRD
                place = (own[some] + docs_).astype(np.uint64)
                held.append((nodes[rows], ids[rows], known[rows], np.bincount(own, minlength=len(t)).astype("<i8"), (h[some] << np.uint64(16)) | place))
                bytes_, docs_ = bytes_ + len(t.data), docs_ + len(t)
                if bytes_ >= CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, grams, heads = [], [], []
        for b in batches:
            for row in b.to_pylist():
                if row["grams"] is None:
                    heads.append(row)
                else:
                    chunks.append(row["chunk"])
                    grams.append(np.frombuffer(row["grams"], np.uint64))
        out = [(r["chunk"], r["nodes"], r["ids"], r["known"], r["sizes"], None) for r in heads]
        if grams:
            every = np.concatenate(grams)
            origin = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            order = np.argsort(every >> np.uint64(16), kind="stable")
            h = every[order] >> np.uint64(16)
            differs = np.concatenate([[True], h[1:] != h[:-1], [True]])
            alone = order[differs[:-1] & differs[1:]]
            alone = alone[(every[alone] & _MANY) != _MANY]
            place, origin = (every[alone] & _MANY).astype("<u2"), origin[alone]
            by = np.argsort(origin, kind="stable")
            cut = np.searchsorted(origin[by], np.arange(len(chunks) + 1))
            out += [(c, None, None, None, None, place[by[i:j]].tobytes()) for c, i, j in zip(chunks, cut[:-1], cut[1:])]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["chunk", "nodes", "ids", "known", "sizes", "alone"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, counts = {}, {}
        for b in batches:
            for row in b.to_pylist():
                c = row["chunk"]
                if row["nodes"] is not None:
                    heads[c] = row
                else:
                    got = np.bincount(np.frombuffer(row["alone"], "<u2"))
                    old = counts.get(c, np.zeros(0, np.int64))
                    both = np.zeros(max(len(got), len(old)), np.int64)
                    both[: len(got)] += got
                    both[: len(old)] += old
                    counts[c] = both
        for c, row in heads.items():
            nodes = np.frombuffer(row["nodes"], np.int64)
            alone = np.zeros(len(nodes), np.int64)
            got = counts.get(c, np.zeros(0, np.int64))
            alone[: len(got)] = got
            ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ids, mask=~known), pa.array(np.frombuffer(row["sizes"], "<i8")), pa.array(alone)], names=["node", "doc_id", "n", "alone"])

    rows = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(send, schema).repartition(parts, "bucket").mapInArrow(count, "chunk long, nodes binary, ids binary, known binary, sizes binary, alone binary")
    out = counted.repartition(slices(docs.sparkSession), "chunk").mapInArrow(gather, "node long, doc_id long, n long, alone long")
    return stored(out, "ngrams-sizes")


def _sets(docs: DataFrame, survivors: DataFrame, width: int) -> DataFrame:
    """node, doc_id, n, two sums that tell sets apart, and grams of the survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(2)):
                own, h = ngram_sets(t, width)
                cut = np.searchsorted(own, np.arange(len(t) + 1))
                sums = [np.add.reduceat(np.append(x, np.uint64(0)), cut[:-1]) for x in (mix(h), mix(h ^ np.uint64(0x5555)))]
                rows = slice(t.first, t.first + len(t))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[rows], b.column(1)[rows], pa.array(np.diff(cut)), *[pa.array(s.view(np.int64)) for s in sums], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["node", "doc_id", "n", "s1", "s2", "grams"],
                )

    kept = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(survivors.select("node").hint("shuffle_hash"), "node", "left_semi")
    return stored(kept.mapInArrow(run, "node long, doc_id long, n long, s1 long, s2 long, grams array<long>"), "ngrams-sets")


def _shared_grams(reps: DataFrame) -> DataFrame:
    """rep, n, gram, df of every n-gram that two or more representatives have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], []]
        for b in batches:
            for k in range(3):
                cols[k].append(b.column(k).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        rep, n, gram = map(np.concatenate, cols)
        order = np.argsort(gram, kind="stable")
        rep, n, gram = rep[order], n[order], gram[order]
        at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        df = np.diff(np.append(at, len(gram)))
        df = np.repeat(df, df)
        many = df > 1
        rep, n, gram, df = rep[many], n[many], gram[many], df[many]
        for i in range(0, len(rep), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (rep, n, gram, df)], names=["rep", "n", "gram", "df"])

    rows = reps.select("rep", "n", F.explode("grams").alias("gram"))
    return rows.repartition(2 * slices(reps.sparkSession), "gram").mapInArrow(run, "rep long, n long, gram long, df long")


def _least_overlap(percent: int) -> Column:
    """ceil(percent / 100 * n): what a partner of a set of n must share at least."""
    return F.floor((F.col("n") * percent + 99) / 100)


def _links(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of representatives that link; together they span every component.
    And rep, n and order (shared n-grams) of those that may link."""
    tokens = stored(_shared_grams(reps), "ngrams-shared")
    place = F.struct("df", "gram")
    # Pivots of the global order, at even shares of the n-grams left.
    weight = (F.col("df") * F.lit(1 << 20) + F.shiftrightunsigned("gram", 28)).cast("long")
    pivots = tokens.agg(F.percentile_approx(weight, [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or []  # FRAGMENTS - 1 numbers
    fragment = sum((F.when(weight >= p, 1).otherwise(0) for p in pivots), F.lit(0))
    per = tokens.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram", fragment.alias("f")))).alias("order"))
    # Members that no other representative has come first in the order.
    live = (F.col("n") - _least_overlap(percent) + 1 - (F.col("n") - F.size("order"))).cast("int")
    per = stored(per.withColumn("live", live).filter("live > 0"), "ngrams-order")
    # left: how many members the set has from this one on, itself included.
    prefix = per.select("rep", "n", F.size("order").alias("live_all"), F.posexplode(F.slice("order", F.lit(1), F.col("live"))).alias("at", "x"))
    prefix = stored(prefix.select("rep", "n", (F.col("live_all") - F.col("at")).cast("long").alias("left"), "x.gram"), "ngrams-prefixes")
    segments = per.select("rep", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("f"), "order")
    segments = segments.select("rep", "f", F.transform(F.filter("order", lambda x: x["f"] == F.col("f")), lambda x: x["gram"]).alias("segment"))
    segments = stored(segments.filter(F.size("segment") > 0), "ngrams-segments")
    # First round: each list with its leader.
    one = F.struct("rep", "n", "left")
    leaders = prefix.groupBy("gram").agg(F.max_by(one, F.struct("left", F.xxhash64("rep"))).alias("l"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    leaders = stored(leaders, "ngrams-leaders")  # so that AQE can split a long list in the join
    met = prefix.join(leaders, (prefix["gram"] == leaders["gram"]) & (prefix["rep"] != F.col("l.rep")) & _could_link(percent))
    links = stored(_linked(_ordered(met), segments, percent), "ngrams-links")
    # Second round: the pairs left between components.
    found = components(links)
    where = prefix.join(found, prefix["rep"] == found["node"], "left").select("rep", "n", "left", "gram", F.coalesce("component", "rep").alias("component"))
    mixed = where.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gram")
    mixed = stored(mixed, "ngrams-mixed")
    rest = stored(where.join(mixed, "gram", "left_semi"), "ngrams-rest")
    other = rest.select(F.col("gram").alias("__gram"), F.struct("rep", "n", "left", "component").alias("l"))
    met = rest.join(other, (F.col("gram") == F.col("__gram")) & (F.col("rep") < F.col("l.rep")) & (F.col("component") != F.col("l.component")) & _could_link(percent))
    return links.union(stored(_linked(_ordered(met), segments, percent), "ngrams-links")), per


def _could_link(percent: int) -> Column:
    """What both sides have left, at most, still makes a link."""
    most = F.least(F.col("left"), F.col("l.left"))
    return 100 * most >= percent * (F.col("n") + F.col("l.n") - most)


def _ordered(met: DataFrame) -> DataFrame:
    """Each pair of rows (rep, n, l) once, as (a, na, b, nb) with a < b."""
    first = F.col("rep") < F.col("l.rep")
    pairs = met.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("rep", "l.rep", "a"), ("n", "l.n", "na"), ("l.rep", "rep", "b"), ("l.n", "n", "nb"))])
    return stored(pairs.distinct(), "ngrams-pairs")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) that link: overlaps by fragment, summed per pair."""
    left = segments.select(F.col("rep").alias("a"), "f", F.col("segment").alias("x"))
    right = segments.select(F.col("rep").alias("b"), F.col("f").alias("g"), F.col("segment").alias("y"))
    met = pairs.join(left, "a").join(right, "b").filter("f = g")
    partial = met.select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).alias("overlap"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("overlap").alias("both"))
    return total.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)]
    owners = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    gram, of = np.unique(np.concatenate(sides), return_inverse=True)
    of = [of[: len(sides[0])], of[len(sides[0]) :]]
    counts = [np.bincount(x, minlength=len(gram)) for x in of]
    pairs = counts[0] * counts[1]
    dense = np.flatnonzero(pairs > DENSE_PAIRS)
    column = np.full(len(gram), -1)
    column[dense] = np.arange(len(dense))
    for k in range(0, len(dense), DENSE_COLUMNS):
        wide = []
        for x, owner, side in zip(of, owners, (a, b)):
            at = column[x] - k
            has = (at >= 0) & (at < DENSE_COLUMNS)
            m = np.zeros((len(side), min(DENSE_COLUMNS, len(dense) - k)), np.float32)
            m[owner[has], at[has]] = 1
            wide.append(m)
        out += wide[0] @ wide[1].T
    few = (pairs > 0) & (pairs <= DENSE_PAIRS)
    x, y = (np.flatnonzero(few[z]) for z in of)
    y = y[np.argsort(of[1][y], kind="stable")]
    first = np.searchsorted(of[1][y], of[0][x])
    n = counts[1][of[0][x]]
    ends = np.cumsum(n)
    flat, cuts = out.reshape(-1), np.searchsorted(ends, np.arange(0, ends[-1] if len(n) else 0, 4_000_000))
    for i, j in zip(cuts, [*cuts[1:], len(n)]):
        k = n[i:j]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        met = owners[1][y[np.repeat(first[i:j], k) + inner]]
        np.add.at(flat, np.repeat(owners[0][x[i:j]], k) * len(b) + met, np.float32(1))
    return out


def _link_counts(per: DataFrame, found: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """rep and links: how many nodes of other representatives each one links to.

    Components that fill more than one block are dealt to several, each pair of
    which is a task; small ones share blocks.
    """
    sets = per.join(found, per["rep"] == found["node"]).join(weights, "rep")
    sets = stored(sets.select("component", "rep", "n", "weight", F.transform("order", lambda x: x["gram"]).alias("grams")), "ngrams-linked")

    def need(docs: Column, grams: Column) -> Column:
        return F.greatest(F.ceil(docs / BLOCK_SETS), F.ceil(grams / BLOCK_GRAMS)).cast("int")

    docs, grams = F.count(F.lit(1)), F.sum(F.size("grams"))
    bins = sets.agg(F.coalesce(need(docs, grams), F.lit(1)).alias("n")).first().n or 1
    blocks = sets.groupBy("component").agg(need(docs, grams).alias("blocks"))
    mine = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(0).cast("int")
    alone = F.col("blocks") == 1
    dealt = sets.join(blocks, "component").withColumn("block", mine)
    dealt = dealt.withColumn("place", F.when(alone, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(alone.alias("alone"), "place", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "n", "weight", "grams")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        i, j = f["i"].iloc[0], f["j"].iloc[0]
        a, b = f[f["block"] == i], f[f["block"] == j]
        both = overlaps(a["grams"].to_list(), b["grams"].to_list())
        na, nb, wa, wb = a["n"].to_numpy(), b["n"].to_numpy(), a["weight"].to_numpy(), b["weight"].to_numpy()
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        to_a, to_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for k in range(0, len(a), 256):
            rows = slice(k, k + 256)
            o = both[rows].astype(np.int64)
            link = (o > 0) & (100 * o >= percent * (na[rows, None] + nb[None, :] - o)) & (ra[rows, None] != rb[None, :])
            to_a[rows] = link @ wb
            to_b += wa[rows] @ link
        out = [(ra, to_a)] if i == j else [(ra, to_a), (rb, to_b)]
        return pd.DataFrame({"rep": np.concatenate([x for x, _ in out]), "links": np.concatenate([x for _, x in out])})

    counted = dealt.groupBy("alone", "place", "i", "j").applyInPandas(run, "rep long, links long")
    return stored(counted.groupBy("rep").agg(F.sum("links").alias("links")), "ngrams-counts")


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """node, doc_id and n of every row of docs; node, doc_id, rep and component
    (a node that names it) of those with a set that others may link to; and what
    _link_counts takes: the sets in order and each one's component."""
    sizes = set_sizes(docs, width)
    may = sizes.filter((F.col("n") > 0) & (100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))).select("node").distinct()
    sets = _sets(docs, may, width)
    # A representative is named by a hash of its set, so no join has to find it.
    sets = sets.withColumn("rep", F.xxhash64("n", "s1", "s2"))
    member = stored(sets.select("node", "doc_id", "rep").distinct(), "ngrams-members")
    first = stored(member.groupBy("rep").agg(F.min("node").alias("node")).select("node"), "ngrams-first")
    own = sets.join(first, "node", "left_semi").select("rep", "n", "grams").dropDuplicates(["rep"])
    links, per = _links(own, percent)
    found = components(links)
    joined = member.join(found.withColumnRenamed("node", "__rep"), F.col("rep") == F.col("__rep"), "left").select("node", "doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    return sizes, stored(joined, "ngrams-joined"), per, found


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """node, doc_id, n_shingles, component_id and n_links of every row of docs."""
    sizes, joined, per, found = _grouped(docs, width, percent)
    names = stored(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ngrams-names")
    weights = stored(joined.groupBy("rep", "component").agg(F.count(F.lit(1)).alias("weight")), "ngrams-weights")
    counts = weights.join(_link_counts(per, found, weights.select("rep", "weight"), percent), "rep", "left").join(names, "component")
    counts = stored(counts.select("rep", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngrams-reps")
    ids = joined.join(counts, "rep").select("node", "component_id", "n_links").distinct()
    out = sizes.join(ids, "node", "left").select("node", "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.withColumns({"component_id": F.coalesce("component_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0))})


def deduplicated(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with one row of each component: the one with its smallest id (of
    several with that id, the one with the smallest hash; a null id only where
    there is no other), and of rows with equal id and text one; all columns
    stay. Rows without links are components of their own, whatever their ids."""
    sizes, joined, _, _ = _grouped(docs, width, percent)
    found = sizes.join(joined.select("node", "component").distinct(), "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    best = found.groupBy("component").agg(F.min(order).alias("x")).select(F.col("x.node").alias("__node"))
    return sheltered(docs, lambda d: d.withColumn("__node", _node()).join(best.hint("shuffle_hash"), "__node", "left_semi").dropDuplicates(["__node"]).drop("__node"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
