"""Hierarchical Pitman-Yor language model (operator 4).

Every word seen in training and the start of a text is a context with a
restaurant of its own; all restaurants share one parent, over words. Its base is
uniform over the known words and one unknown word. A restaurant's customers are
the tokens seen in its context; each of its tables is a customer of the parent.
Numbers of tables are sampled by Gibbs: given the parent's probability of a word
and the restaurant's total of tables, the seating of a word's customers is drawn
afresh (from its exact conditional up to EXACT customers, beyond that by a close
approximation, `sample_tables`), then the parent's seating. Predictive probabilities of
SAMPLES sweeps are averaged.

Tokens are shuffled by the word they are: a word's tokens in all contexts and
documents meet in one part, so word counts, seating and the log probabilities of
its tokens are all found there. A word that holds more than half a part's share
of tokens is spread over parts by its contexts; the parent's customers of these
words, at most 8 for each shuffle partition, are summed by Spark and their
parent tables drawn on the driver. Totals of restaurants are summed between
sweeps: each part sends one number for each context it has, tasks that hold a
range of contexts add them, and the sums go back to the parts that asked. So a
context sends at most one number from each part, however frequent it is. A sweep
is drawn again from its seed where its totals are needed, so restaurants are
normalised exactly by the totals of their own sample.

Defined cases: a null or empty text is the end token alone; a null id is never
held out; repeated ids are scored row by row; without training documents every
score is the uniform base; an empty table gives an empty result; other columns
are ignored. Very long texts are cut nowhere: a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.common import slices, stored
from siteledger.llm.textops import mix, span_hashes, spans, texts

STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 3
EXACT = 64
SEED = 11
CHUNK_BYTES = 10_000_000
#: Documents whose sums a task holds before it sends them on.
HELD_DOCS = 1_000_000
CHUNK_DOCS = 60_000
#: Training tokens for each task that adds totals by context, up to the number of shuffle partitions.
HOME_TOKENS = 1_000_000
_END = np.uint64(0xE9D0000000000001)
_START = np.uint64(0x57A4000000000001)


@dataclass
class Root:
    """The parent's customers and tables: of all words, and of each hot word."""

    customers: float
    tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Totals:
    """What all parts share: the hot words, and sums over the whole corpus."""

    parts: int
    homes: int  # ranges of contexts whose totals are added in one task
    hot: np.ndarray  # hashes of the words that are spread over parts, in ascending order
    hot_counts: np.ndarray
    tokens: int = 0
    words: int = 0
    leaf_discount: float = 0.5
    root_discount: float = 0.5
    root: Root | None = None
    samples: tuple[Root, ...] = ()

    def subs(self) -> np.ndarray:
        """How many parts each hot word is spread over; at most one part's share of tokens each."""
        return np.maximum(-(-self.hot_counts * self.parts // max(self.tokens, 1)), 1)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in the least number of bytes that holds them all, byte by byte and compressed."""
    most = int(values.max(initial=0))
    size = next(k for k in range(1, 9) if most < 1 << (8 * k))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
    return bytes([size]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    size = next(k for k in (1, 2, 4, 8) if raw[0] <= k)
    out = np.zeros((n // raw[0], size), np.uint8)
    out[:, : raw[0]] = planes.reshape(raw[0], -1).T
    return out.view(f"<u{size}").ravel()


def _pack_hashes(ascending: np.ndarray) -> bytes:
    return _pack(np.diff(ascending, prepend=np.uint64(0)))


def _unpack_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _tokens(t, held_rows: np.ndarray):
    """Hash of each token and of the one before it, and its text; in order of texts."""
    starts, ends, owner = spans(t)
    h = span_hashes(t, starts, ends, True)
    n = len(t)
    at = np.searchsorted(owner, np.arange(n), side="right") + np.arange(n)  # place of each end token
    word = np.empty(len(h) + n, np.uint64)
    mine = np.empty(len(h) + n, np.int64)
    is_end = np.zeros(len(h) + n, bool)
    is_end[at] = True
    word[is_end], word[~is_end] = _END, h
    mine[is_end], mine[~is_end] = np.arange(n), owner
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.concatenate([[0], at[:-1] + 1])] = _START
    return word, before, mine


@lru_cache(maxsize=4)
def _stirling(discount: float) -> list[np.ndarray]:
    """Logs of generalised Stirling numbers: ways to seat c customers at t tables."""
    rows = [np.full(EXACT + 2, -np.inf)]
    rows[0][0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, EXACT + 2)
        row = np.full(EXACT + 2, -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            row[1:] = np.logaddexp(rows[c][:-1], np.log(np.maximum(c - t * discount, 0)) + rows[c][1:])
        rows.append(row)
    return rows


def _held(free: np.ndarray, end: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """By what a table more scales the weight of the customers still to come: each of
    them finds discount places fewer at the tables there are. free and end: customers
    less discount times tables, now and when all are seated."""
    out = (free / end) ** discount
    for _ in range(4):  # some of those to come open tables of their own
        out = ((free + pull * out) / (end + pull)) ** discount
    return out


def sample_tables(c: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word with c customers, where a new table weighs pull
    (parent's probability times strength plus discount times all tables).

    Up to EXACT customers they are drawn from the exact conditional. Of more, the
    first EXACT are drawn so, each of their tables weighed by what it does to those
    to come; the others follow in groups of a quarter of those seated, whose chance of
    a table of their own is weighed the same way."""
    out = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    cut = np.searchsorted(c[order], np.arange(EXACT + 2))
    logs = _stirling(discount)
    for k in range(2, EXACT + 2):
        at = order[cut[k] : cut[k + 1] if k <= EXACT else len(order)]
        tables = np.arange(1, min(k, EXACT) + 1)
        for i in range(0, len(at), 400_000 // k):
            some = at[i : i + 400_000 // k]
            p = np.maximum(pull[some], 1e-300)[:, None]
            w = logs[len(tables)][tables] + tables * np.log(p)
            if k > EXACT:
                taken = discount * (tables - 0.5)
                w = w + np.cumsum(np.log(_held(EXACT - taken, c[some][:, None] - taken, p, discount)), axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            u = rng.random(len(some)) * w[:, -1]
            out[some] = np.minimum((w < u[:, None]).sum(axis=1) + 1, len(tables))
    big = order[cut[EXACT + 1] :]
    seated = np.full(len(big), EXACT, dtype=np.int64)
    while len(big):
        more = np.minimum(seated // 4, c[big] - seated)
        taken = discount * out[big]
        free = seated + (more - 1) / 2 - taken
        new = pull[big] * _held(free, c[big] - taken, pull[big], discount)
        out[big] += rng.binomial(more, np.clip(new / np.maximum(free + new, 1e-9), 0, 1))
        seated = seated + more
        left = seated < c[big]
        big, seated = big[left], seated[left]
    return out


STATE = "part int, words binary, pairs binary, contexts binary, context binary, runs binary, place binary, train binary, chunks binary, n_docs binary"
#: What parts are told: tag 0 has customers of each context and its tables at first, 1 the tables after the burn-in, 2 the tables of each sample.
TOLD = "part int, home int, tag int, told binary"
ROWS = (2, 1, SAMPLES)


class Part:
    """All tokens of some words, or those of one hot word in some contexts."""

    def __init__(self, row: dict, told: dict[int, list]) -> None:
        self.part = row["part"]
        self.words, self.contexts = _unpack_hashes(row["words"]), _unpack_hashes(row["contexts"])
        self.n = len(self.words)
        self.pair_word = np.repeat(np.arange(self.n), _unpack(row["pairs"]))
        self.pair_context, self.runs = _unpack(row["context"]).astype(np.int64), _unpack(row["runs"]).astype(np.int64)
        self.place = _unpack(row["place"])
        train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.place))
        self.chunks = np.frombuffer(row["chunks"], "<i8")
        self.n_docs = np.frombuffer(row["n_docs"], "<i8")
        first = np.cumsum(self.runs) - self.runs
        self.count = np.add.reduceat(train, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        self.seen = np.bincount(self.pair_word, weights=self.count, minlength=self.n).astype(np.int64)
        self.own = np.flatnonzero(self.count > 0)  # pairs that have customers
        self.told = {tag: np.concatenate([_unpack(x).reshape(ROWS[tag], -1) for _, x in sorted(got)], axis=1) for tag, got in told.items()}

    def is_hot(self, totals: Totals) -> bool:
        return self.part >= totals.parts

    def hot(self, totals: Totals) -> int:
        return int(np.searchsorted(totals.hot, self.words[0]))

    def parent(self, totals: Totals, root: Root, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The parent's probability of each word."""
        if self.is_hot(totals):
            k = self.hot(totals)
            c0, t0 = root.hot_customers[k : k + 1], root.hot_tables[k : k + 1]
        new = (STRENGTH + totals.root_discount * root.tables) / (totals.words + 1)
        return (c0 - totals.root_discount * t0 + new) / (STRENGTH + root.customers)

    def sweeps(self, totals: Totals, stage: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """n Gibbs sweeps: tables of each own pair; customers and tables of the parent by word.

        Stage 0 starts from one table for each context, stage 1 from the tables after the burn-in."""
        rng = np.random.default_rng([SEED, self.part, stage])
        word, context, c = self.pair_word[self.own], self.pair_context[self.own], self.count[self.own]
        tables = self.told[1][0] if stage else self.told[0][1]
        d, d0 = totals.leaf_discount, totals.root_discount
        new_leaf = (STRENGTH + d * tables.astype(float))[context]
        new_root = np.full(self.n, (STRENGTH + d0 * totals.root.tables) / (totals.words + 1))
        t, t0 = np.ones(len(c), np.int64), np.minimum(self.seen, 1)
        for _ in range(n):
            c0 = np.bincount(word, weights=t, minlength=self.n).astype(np.int64)
            t = sample_tables(c, new_leaf * self.parent(totals, totals.root, c0, t0)[word], d, rng)
            c0 = np.bincount(word, weights=t, minlength=self.n).astype(np.int64)
            if not self.is_hot(totals):
                t0 = sample_tables(c0, new_root, d0, rng)
            yield t, c0, t0

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_context[self.own], weights=values, minlength=len(self.contexts)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The parts of a task, each with all that it was told."""
    states: dict[int, dict] = {}
    told: dict[int, dict[int, list]] = {}
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            if r["words"] is None:
                told.setdefault(r["part"], {}).setdefault(r["tag"], []).append((r["home"], r["told"]))
            else:
                states[r["part"]] = r
    for part in sorted(states):
        yield Part(states.pop(part), told.pop(part, {}))


def _told(state: DataFrame, parts: int, *answers: DataFrame) -> DataFrame:
    """Rows of the state beside the sums sent to them, dealt by part."""
    for a in answers:
        state = state.unionByName(a, allowMissingColumns=True)
    return state.repartition(parts, "part") if answers else state


def count_words(docs: DataFrame) -> DataFrame:
    """hash and count of words that occur twice or more in training texts, and
    a row with a null hash for each part: its tokens, words, and words seen once and twice."""
    parts = 2 * slices(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            cut = np.searchsorted(h >> np.uint64(32), (np.arange(parts + 1) * (1 << 32) // parts).astype(np.uint64))
            rows = [(k, _pack_hashes(h[a:b]), _pack(n[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], names=["part", "words", "counts"])

        for b in batches:
            out = b.column(1).to_numpy(zero_copy_only=False)
            for t in texts(b.column(2)):
                word, _, mine = _tokens(t, out)
                held.append(word[~out[t.first + mine]])
                size += len(t.data)
                if size > CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for b in batches:
            words += [_unpack_hashes(x) for x in b.column(1).to_pylist()]
            counts += [_unpack(x) for x in b.column(2).to_pylist()]
        if words:
            h, of = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(of, weights=np.concatenate(counts)).astype(np.int64)
            some = n > 1
            none = pa.nulls(int(some.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some]), none, none, none], names=["hash", "n", "words", "once", "twice"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.array([int(x)]) for x in (n.sum(), len(n), (n == 1).sum(), (n == 2).sum())]], names=["hash", "n", "words", "once", "twice"])

    sent = docs.mapInArrow(send, "part int, words binary, counts binary").repartition(parts, "part")
    return stored(sent.mapInArrow(add, "hash long, n long, words long, once long, twice long"), "lm-words")


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def by_word(docs: DataFrame, totals: Totals) -> tuple[DataFrame, DataFrame]:
    """Tokens by word, a row (STATE) a part; and rows of documents by chunk.

    A part holds the words of a range of hashes; a hot word has parts of its own."""
    parts, hot, subs = totals.parts, totals.hot, totals.subs()
    own = parts + np.cumsum(subs) - subs  # the first part of each hot word
    columns = ["part", "chunk", "words", "counts", "contexts", "context", "place", "train", "ids", "known", "held", "tokens"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_chunks = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = docs_ = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, docs_, n_chunks
            word, before, place = (np.concatenate([x[k] for x in held]) for k in range(3))
            ids, valid, out, tokens = (np.concatenate([x[k] for x in held]) for k in range(3, 7))
            order = np.argsort(word, kind="stable")
            word = word[order]
            lo, hi = np.searchsorted(word, hot), np.searchsorted(word, hot, side="right")
            for k in np.flatnonzero(subs > 1):
                some = order[lo[k] : hi[k]]
                order[lo[k] : hi[k]] = some[np.argsort(mix(before[some]) % np.uint64(subs[k]), kind="stable")]
            before, place = before[order], place[order].astype("<u2")
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            chunk, train = base + n_chunks, np.packbits(~out).tobytes()
            n_chunks += 1
            rows = [(chunk % parts, chunk, None, None, None, None, None, None, ids.tobytes(), valid.tobytes(), out.tobytes(), tokens.astype("<i8").tobytes())]

            def add(part: int, a: int, b: int) -> None:
                if b > a:
                    f = first[np.searchsorted(first, a) : np.searchsorted(first, b)]
                    f = f if len(f) and f[0] == a else np.append(a, f)
                    names, context = np.unique(before[a:b], return_inverse=True)
                    rows.append((part, chunk, _pack_hashes(word[f]), _pack(np.diff(np.append(f, b))), _pack_hashes(names), _pack(context), _pack(place[a:b]), train, None, None, None, len(ids).to_bytes(8, "little")))

            for k, (a, b) in enumerate(zip(lo, hi)):
                at = a + np.searchsorted(mix(before[a:b]) % np.uint64(subs[k]), np.arange(subs[k] + 1, dtype=np.uint64))
                for sub, (i, j) in enumerate(zip(at[:-1], at[1:])):
                    add(int(own[k]) + sub, i, j)
            # Ranges of hashes, cut again wherever a frequent word stands.
            cut = np.searchsorted(word >> np.uint64(32), (np.arange(parts + 1) * (1 << 32) // parts).astype(np.uint64))
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                for i, j in zip(lo[(lo >= a) & (lo < b)], hi[(lo >= a) & (lo < b)]):
                    add(k, a, i)
                    a = j
                add(k, a, b)
            held, size, docs_ = [], 0, 0
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=columns)

        for b in batches:
            ids = b.column(0)
            valid, out = ids.is_valid().to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for t in texts(b.column(2)):
                if docs_ + len(t) > CHUNK_DOCS:
                    yield from flush()
                word, before, mine = _tokens(t, out)
                rows = slice(t.first, t.first + len(t))
                held.append((word, before, mine + docs_, ids[rows], valid[rows], out[rows], np.bincount(mine, minlength=len(t))))
                size, docs_ = size + len(t.data), docs_ + len(t)
                if size > CHUNK_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, by_part = [], {}
        for b in batches:
            for r in b.to_pylist():
                if r["words"] is None:
                    heads.append(r)
                else:
                    by_part.setdefault(r["part"], []).append(r)
        empty = (None,) * 8
        rows = [(*empty, np.array([r["chunk"]], "<i8").tobytes(), r["ids"], r["known"], r["held"], r["tokens"]) for r in heads]
        if rows:
            yield batch(rows)
        for part in sorted(by_part):
            yield batch([merged(part, by_part.pop(part))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=[*[x.split()[0] for x in STATE.split(", ")], "known", "held", "tokens"])

    def merged(part: int, got: list[dict]) -> tuple:
        """One row of all messages of a part; a chunk may have sent several."""
        got.sort(key=lambda r: r["chunk"])
        chunks, nth = np.unique(np.array([r["chunk"] for r in got], "<i8"), return_inverse=True)
        docs_of = np.zeros(len(chunks), "<i8")
        for r, k in zip(got, nth):
            docs_of[k] = int.from_bytes(r["tokens"], "little")
        before = np.concatenate([[0], np.cumsum(docs_of)[:-1]])
        words = np.unique(np.concatenate([_unpack_hashes(r["words"]) for r in got]))
        of = np.concatenate([np.repeat(np.searchsorted(words, _unpack_hashes(r["words"])), _unpack(r["counts"])) for r in got])
        names = [_unpack_hashes(r["contexts"]) for r in got]
        contexts, at = np.unique(np.concatenate(names), return_inverse=True)
        at = np.split(at, np.cumsum([len(x) for x in names])[:-1])
        context = np.concatenate([x[_unpack(r["context"])] for x, r in zip(at, got)])
        local = [_unpack(r["place"]) for r in got]
        train = np.concatenate([np.unpackbits(np.frombuffer(r["train"], np.uint8))[x] for r, x in zip(got, local)])
        place = np.concatenate([x + before[k] for x, k in zip(local, nth)])
        pair = of * len(contexts) + context
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pairs = np.bincount(pair[first] // len(contexts), minlength=len(words))
        arrays = (_pack(pairs), _pack_hashes(contexts), _pack(pair[first] % len(contexts)), _pack(np.diff(np.append(first, len(pair)))), _pack(place[order]))
        return part, _pack_hashes(words), *arrays, np.packbits(train[order]).tobytes(), chunks.tobytes(), docs_of.tobytes(), None, None, None

    sent = docs.mapInArrow(send, ", ".join([f"{columns[0]} int", f"{columns[1]} long", *[f"{c} binary" for c in columns[2:]]])).repartition(parts, "part")
    both = stored(sent.mapInArrow(merge, STATE + ", known binary, held binary, tokens binary"), "lm-tokens")
    state = both.filter("part is not null").select(*[x.split()[0] for x in STATE.split(", ")])
    heads = both.filter("part is null").select("chunks", F.col("n_docs").alias("ids"), "known", "held", "tokens")
    return state, heads


SENT = "home int, part int, names binary, told binary, sample int, key long, x double"
_TABLES, _CUSTOMERS, _ONCE, _TWICE = -1, -2, -3, -4  # keys of sums over all; others are hot words


def _messages(p: Part, homes: int, values: np.ndarray, sums: list[tuple[int, int, float]]) -> pa.RecordBatch:
    """What a part sends: values (a row each) of its contexts to those that add them, and sums over all."""
    cut = np.searchsorted(p.contexts >> np.uint64(32), (np.arange(homes + 1) * (1 << 32) // homes).astype(np.uint64))
    rows = [(k, p.part, _pack_hashes(p.contexts[a:b]), _pack(values[:, a:b].ravel()), None, None, None) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    rows += [(p.part % homes, p.part, None, None, *x) for x in sums]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SENT.split(", ")])


def _exchange(sent: DataFrame, tag: int) -> tuple[DataFrame, dict[tuple[int, int], float]]:
    """Sums by context, sent back to each part that has the context (TOLD); and
    sums over all parts by sample and key, a bounded number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, back, sums = [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                if r["names"] is None:
                    sums.append((None, None, None, None, r["sample"], r["key"], r["x"]))
                else:
                    names.append(_unpack_hashes(r["names"]))
                    values.append(_unpack(r["told"]).reshape(ROWS[tag], -1))
                    back.append((r["part"], r["home"], tag))
        rows = sums
        if names:
            _, of = np.unique(np.concatenate(names), return_inverse=True)
            total = np.stack([np.bincount(of, weights=np.concatenate([v[k] for v in values]))[of].astype(np.int64) for k in range(ROWS[tag])])
            at = np.cumsum([0] + [len(x) for x in names])
            rows += [(*r, _pack(total[:, a:b].ravel()), None, None, None) for r, a, b in zip(back, at[:-1], at[1:])]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "home", "tag", "told", "sample", "key", "x"])

    out = stored(sent.repartition(slices(sent.sparkSession), "home").mapInArrow(add, TOLD + ", sample int, key long, x double"), "lm-totals")
    sums = out.filter("part is null").groupBy("sample", "key").agg(F.sum("x").alias("x")).collect()  # a row a sample and hot word
    return out.filter("part is not null").select("part", "home", "tag", "told"), {(r.sample, r.key): r.x for r in sums}


def _roots(totals: Totals, sums: dict[tuple[int, int], float], samples: int, stage: int) -> tuple[Root, ...]:
    """The parent's totals by sample; tables of hot words are drawn here."""
    rng = np.random.default_rng([SEED, stage])
    out = []
    for k in range(samples):
        c = np.array([sums.get((k, h), 0) for h in range(len(totals.hot))], dtype=np.int64)
        new = (STRENGTH + totals.root_discount * totals.root.tables) / (totals.words + 1) if totals.root else 0.0
        t = sample_tables(c, np.full(len(c), new), totals.root_discount, rng) if totals.root else np.minimum(c, 1)
        out.append(Root(sums.get((k, _CUSTOMERS), 0.0) + c.sum(), sums.get((k, _TABLES), 0.0) + t.sum(), c, t))
    return tuple(out)


def _of_parent(p: Part, totals: Totals, sample: int, c0: np.ndarray, t0: np.ndarray) -> list[tuple[int, int, float]]:
    if p.is_hot(totals):
        return [(sample, p.hot(totals), float(c0.sum()))]
    return [(sample, _CUSTOMERS, float(c0.sum())), (sample, _TABLES, float(t0.sum()))]


def _initial(state: DataFrame, totals: Totals) -> DataFrame:
    """Customers of each restaurant and the words it has seen; sets the parent's totals and the leaf discount."""
    homes = totals.homes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            c = p.count[p.own]
            c0 = np.bincount(p.pair_word[p.own], minlength=p.n)
            sums = _of_parent(p, totals, 0, c0, np.minimum(c0, 1))
            sums += [(0, _ONCE, float((c == 1).sum())), (0, _TWICE, float((c == 2).sum()))]
            yield _messages(p, homes, np.stack([p.by_context(c), p.by_context(np.ones(len(c)))]), sums)

    told, sums = _exchange(state.mapInArrow(run, SENT), 0)
    totals.leaf_discount = _discount(sums.get((0, _ONCE), 0), sums.get((0, _TWICE), 0))
    totals.root = _roots(totals, sums, 1, 0)[0]
    return told


def _sweep_totals(state: DataFrame, totals: Totals, stage: int, skip: int, samples: int) -> tuple[DataFrame, tuple[Root, ...]]:
    """Tables of each context and the parent's totals, for each sample after the skipped sweeps."""
    homes, now = totals.homes, replace(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            values, sums = [], []
            for k, (t, c0, t0) in enumerate(p.sweeps(now, stage, skip + samples)):
                if k >= skip:
                    values.append(p.by_context(t))
                    sums += _of_parent(p, now, k - skip, c0, t0)
            yield _messages(p, homes, np.stack(values), sums)

    told, sums = _exchange(state.mapInArrow(run, SENT), 1 + stage)
    return told, _roots(totals, sums, samples, 1 + stage)


def _scored(state: DataFrame, heads: DataFrame, totals: Totals) -> DataFrame:
    """Sums by document, from every part that has some of its tokens."""
    totals = replace(totals)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = totals.leaf_discount
        held: dict[int, np.ndarray] = {}  # by chunk: three sums of each document
        first, docs = None, 0
        for p in _parts(batches):
            first = p.part if first is None else first
            # A pair's number among those with customers; the others have none.
            own = np.full(len(p.count), -1)
            own[p.own] = np.arange(len(p.own))
            total = np.zeros(len(p.count))
            customers = p.told[0][0].astype(float)[p.pair_context]
            for k, (t, c0, t0) in enumerate(p.sweeps(totals, 1, 1 + SAMPLES)):
                if not k:
                    continue
                there = p.parent(totals, totals.samples[k - 1], c0, t0)[p.pair_word]
                tables = p.told[2][k - 1].astype(float)[p.pair_context]
                seats = np.where(own >= 0, p.count - d * np.append(t, 0)[own], 0.0)
                leaf = (seats + (STRENGTH + d * tables) * there) / (STRENGTH + customers)
                total += np.where(customers > 0, leaf, there)
            seen = totals.hot_counts[[p.hot(totals)]] if p.is_hot(totals) else p.seen
            n = int(p.n_docs.sum())
            by_pair = (np.log10(total / SAMPLES), np.log10(seen + 0.5)[p.pair_word], (seen > 0)[p.pair_word].astype(float))
            sums = np.stack([np.bincount(p.place, weights=np.repeat(w, p.runs), minlength=n) for w in by_pair])
            cut = np.concatenate([[0], np.cumsum(p.n_docs)])
            for c, a, b in zip(p.chunks.tolist(), cut[:-1], cut[1:]):
                if c in held:
                    held[c] += sums[:, a:b]
                else:
                    held[c] = sums[:, a:b].copy()
                    docs += b - a
            if docs > HELD_DOCS:
                yield sent_on(held, first)
                held, first, docs = {}, None, 0
        if held:
            yield sent_on(held, first)

    def sent_on(held: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        n = len(held)
        cols = [[x[k].tobytes() for x in held.values()] for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([part] * n, pa.int32()), *[pa.array(c, pa.binary()) for c in cols], *[pa.nulls(n, pa.binary())] * 2], names=names)

    names = ["chunk", "part", "a", "b", "c", "d", "e"]
    kind = "chunk long, part int, a binary, b binary, c binary, d binary, e binary"

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                chunk = int(np.frombuffer(r["chunks"], "<i8")[0])
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1], pa.int32()), *[pa.array([r[c]], pa.binary()) for c in ("ids", "known", "held", "tokens")], pa.array([b"head"], pa.binary())], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                chunks.setdefault(r["chunk"], []).append(r)
        m = totals
        for rows in chunks.values():
            first, *rest = sorted(rows, key=lambda r: r["part"])
            ids, valid, out = np.frombuffer(first["a"], np.int64), np.frombuffer(first["b"], bool), np.frombuffer(first["c"], bool)
            tokens = np.frombuffer(first["d"], "<i8")
            score_, base, seen = (sum((np.frombuffer(r[c]) for r in rest), np.zeros(len(ids))) for c in ("a", "b", "c"))
            base = base - tokens * np.log10(m.tokens + 0.5 * (m.words + 1))
            cols = [pa.array(ids, mask=~valid), pa.array(out), pa.array(tokens), pa.array(seen.astype(np.int64)), pa.array(np.full(len(ids), m.tokens)), pa.array(base), pa.array(score_)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = state.mapInArrow(score, kind).unionByName(heads.mapInArrow(head, kind))
    out = rows.repartition(slices(state.sparkSession), "chunk")
    return out.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 probability of the text) of rows (doc_id, held_out, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    spark = docs.sparkSession
    words = count_words(docs)
    sums = words.filter("hash is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "words", "once", "twice")]).first()
    parts = 4 * slices(spark)
    hot = words.filter(F.col("hash").isNotNull() & (F.col("n") * 2 * parts > sums.n)).select("hash", "n").toArrow()  # fewer than 2 * parts rows
    hashes, counts = hot["hash"].to_numpy().view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(hashes)
    homes = int(min(slices(spark), max(sums.n // HOME_TOKENS, 1)))
    totals = Totals(parts, homes, hashes[order], counts[order], sums.n, sums.words, root_discount=_discount(sums.once, sums.twice))
    state, heads = by_word(docs, totals)
    first = _initial(state, totals)
    burnt, (totals.root,) = _sweep_totals(_told(state, parts, first), totals, 0, BURN_IN, 1)
    tables, totals.samples = _sweep_totals(_told(state, parts, first, burnt), totals, 1, 1, SAMPLES)
    return _scored(_told(state, parts, first, burnt, tables), heads, totals)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_documents(docs.select("doc_id", (fold == 1).alias("held_out"), "text"))
