"""Periodic runs of words (operator 12), by online dyadic square catching.

A run is a longest stretch of words that repeats with a period q: words q apart
are equal, the stretch has at least two periods and LEAST words, and no word
before or after it goes on with q. Words are appended to all sequences of a
batch, some at a time. Whenever a block of 2**k words at a multiple of 2**k is
complete, a catcher looks for the block among the 2**(k+2) words before it:
every equal block p words back starts a comparison of the words there with
those p back, to the left at once, to the right as words arrive. The second
half of a square of period p holds such a block for the k with
2**(k+1) <= p + 1 < 2**(k+2), so no square is missed, and each period belongs
to one k. A comparison that has passed p words has caught a square, and the
squares it goes on to catch are one run; it ends at the first word that
differs. Comparisons take strides of whole blocks, longest first, by 64-bit
hashes of all blocks appended so far; words themselves are compared exactly, and
each run is checked word by word before it is given.

Spark deals documents to tasks as they are read; nothing is shuffled. A task
holds some megabytes of texts, or one longer text, with 8 bytes a word and k.
Periods of a block are looked up in 2n comparisons a k, so n words take
n log n comparisons, also where all words are equal.

Defined cases: a null, empty or blank text has no word and no run, its collapsed
text is empty; rows are judged one by one, so repeated ids and rows are kept; an
empty table gives an empty result; very long texts are handled whole, alone in
their batch; other columns are ignored; a null id is kept, and nothing is planted
in its text by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.textops import Texts, mix, spans, texts

#: Least words of a run.
LEAST = 12
#: Words appended to a sequence at a time. Any number gives the same runs.
APPEND = 1 << 16

RUNS = "array<struct<start:long,length:long,period:long>>"


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of [low, high) of each entry, and the entry of each."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


class Catchers:
    """Runs of several sequences to which words are appended.

    Sequences lie end to end in flat arrays of their final size; positions are
    those of the flat arrays."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> None:
        self.words, self.least = words, least
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.known = self.first.copy()  # end of what has been appended
        longest = int(sizes.max(initial=0))
        n_levels = max(1, ((longest + 2) // 4).bit_length())
        self.hashes = [np.zeros(len(words), np.uint64) for _ in range(n_levels)]
        self.open = np.zeros((3, 0), np.int64)  # sequence, period, first equal word
        self.caught: list[np.ndarray] = []  # first word, end, period

    def _hash(self, old: np.ndarray) -> None:
        """Hashes of the blocks that the new words complete, at any position."""
        at, _ = _ranges(old, self.known)
        self.hashes[0][at] = mix(self.words[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(1, len(self.hashes)):
            half = 1 << (k - 1)
            low = np.maximum(self.first, old - 2 * half + 1)
            at, _ = _ranges(low, self.known - 2 * half + 1)
            if not len(at):
                break
            below = self.hashes[k - 1]
            self.hashes[k][at] = mix(below[at] * np.uint64(0xD6E8FEB86659FD93) + below[at + half])

    def _onward(self, at: np.ndarray, period: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far words from at on equal those a period before, up to end."""
        at = at.copy()
        for k in reversed(range(len(self.hashes))):
            todo = np.arange(len(at))
            while len(todo):
                todo = todo[at[todo] + (1 << k) <= end[todo]]
                x = at[todo]
                todo = todo[self.hashes[k][x] == self.hashes[k][x - period[todo]]]
                at[todo] += 1 << k
                if k + 1 < len(self.hashes):
                    break  # two strides of this length would have been one of the next
        return at

    def _back(self, at: np.ndarray, period: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The first of the words up to at that equal those a period before."""
        at = at.copy()
        for k in reversed(range(len(self.hashes))):
            todo = np.arange(len(at))
            while len(todo):
                todo = todo[at[todo] - (1 << k) - period[todo] >= start[todo]]
                x = at[todo] - (1 << k)
                todo = todo[self.hashes[k][x] == self.hashes[k][x - period[todo]]]
                at[todo] -= 1 << k
                if k + 1 < len(self.hashes):
                    break
        return at

    def _catchers(self, k: int, old: np.ndarray) -> np.ndarray:
        """(sequence, period, block) of comparisons that the new blocks of 2**k
        words start."""
        size = 1 << k
        least = np.maximum((old - self.first) // size, 1 if k == 0 else 2)
        nth, owner = _ranges(least, (self.known - self.first) // size)
        if not len(nth):
            return np.zeros((3, 0), np.int64)
        block = self.first[owner] + nth * size
        periods = np.arange(2 * size - 1, 4 * size - 1)
        back = block[:, None] - periods
        equal = self.hashes[k][np.maximum(back, 0)] == self.hashes[k][block][:, None]
        equal &= back >= self.first[owner][:, None]
        # Where the block before goes on with the same period, its comparison does.
        follows = (owner[1:] == owner[:-1])[:, None] & equal[:-1]
        equal[1:] &= ~follows
        row, col = np.nonzero(equal)
        return np.stack([owner[row], periods[col], block[row]])

    def _settle(self, seq: np.ndarray, period: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Keeps comparisons at the end of what is known open, and runs of the others."""
        going = (right == self.known[seq]) & (right < self.last[seq])
        self.open = np.concatenate([self.open, np.stack([seq, period, left])[:, going]], axis=1)
        run = ~going & (right - left >= period) & (right - left + period >= self.least)
        self.caught.append(np.stack([left - period, right, period])[:, run])

    def append(self, n: int = APPEND) -> bool:
        """Appends the next n words of each sequence; whether there were any."""
        old = self.known
        self.known = np.minimum(old + n, self.last)
        if np.array_equal(old, self.known):
            return False
        self._hash(old)
        seq, period, left = self.open
        self.open = np.zeros((3, 0), np.int64)
        self._settle(seq, period, left, self._onward(old[seq], period, self.known[seq]))
        for k in range(len(self.hashes)):
            seq, period, block = self._catchers(k, old)
            if len(seq):
                left = self._back(block, period, self.first[seq])
                self._settle(seq, period, left, self._onward(block + (1 << k), period, self.known[seq]))
        # Several blocks of one stretch lead to one comparison.
        _, one = np.unique(self.open[1:], axis=1, return_index=True)
        self.open = self.open[:, one]
        return True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, first word, end and smallest period of each run so far, in order."""
        start, end, period = np.concatenate([np.zeros((3, 0), np.int64), *self.caught], axis=1)
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        # A stretch with multiples of its period is caught for each: the first is smallest.
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        at, owner = _ranges(start + period, end)
        if (self.words[at] != self.words[at - period[owner]]).any():
            raise ArithmeticError("two blocks of words share a hash")
        return np.searchsorted(self.last, start, side="right"), start, end, period


def _joined(t: Texts, starts: np.ndarray, ends: np.ndarray, spaced: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words end to end, each with spaced spaces after it, and offsets."""
    sizes = ends - starts + spaced
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(offsets[-1], 0x20, np.uint8)
    at, word = _ranges(offsets[:-1], offsets[1:] - spaced)
    out[at] = t.data[at - offsets[word] + starts[word]]
    return out, offsets


def _batch(t: Texts) -> tuple[list, ...]:
    """Columns n_words, runs and collapsed of some texts."""
    starts, ends, owner = spans(t)
    flat, offsets = _joined(t, starts, ends, 0)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.bincount(owner, minlength=len(t)).astype(np.int64)
    catchers = Catchers(ids, sizes)
    while catchers.append():
        pass
    seq, start, end, period = catchers.runs()
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, start + period, 1)
    np.add.at(inside, end, -1)
    kept = np.cumsum(inside)[:-1] == 0
    text, offsets = _joined(t, starts[kept], ends[kept], 1)
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(t)))]).astype(np.int64)
    # Every text with a word keeps one, so each ends in a space that is dropped.
    collapsed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(offsets[edges].astype(np.int64)), pa.py_buffer(text)])
    collapsed = pc.binary_slice(collapsed, 0, -1) if len(text) else collapsed
    values = pa.StructArray.from_arrays([start - catchers.first[seq], end - start, period], ["start", "length", "period"])
    places = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=len(t)))]).astype(np.int32)
    return pa.array(sizes), pa.ListArray.from_arrays(places, values), collapsed.cast(pa.large_string()).cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and
    period) and collapsed: the words that no run holds after its first period,
    joined by spaces. Rows of docs (doc_id, text) are kept one by one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("text")):
                ids = batch.column("doc_id").slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([ids, *_batch(t)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; in a tenth of the documents, chosen by the checksum
    h of the id, the words from word a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__w"), F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) DIV 10").alias("__g"))
    rows = rows.withColumn("__n", F.size("__w").cast("long"))
    rows = rows.withColumn("__a", F.expr("try_mod(__g, __n)")).withColumn("__p", F.expr("1 + (__n - __a) DIV (3 + __g % 8)"))
    moved = F.expr("transform(sequence(0L, __n - 1), i -> __w[CAST(IF(i < __a, i, __a + (i - __a) % __p) AS INT)])")
    return rows.select("doc_id", F.when(F.col("__n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
