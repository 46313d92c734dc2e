"""Best-fit-decreasing packing into fixed-size sequences (operator 6).

Documents are encoded and cut into pieces of at most a sequence's size. Which
piece goes where depends on lengths alone, and there are at most as many
different lengths as a sequence has tokens. So the plan is made from the
histogram of lengths, whose size does not grow with the corpus: lengths in
descending order, each piece into the tightest open sequence it fits, found in
a segment tree over remaining capacities. Sequences in the same state are
handled together, as ranges of numbers, so a length costs as many steps as it
meets different capacities. The result equals piece-by-piece best-fit
decreasing. Spark numbers the pieces of each length (no length in one task) and
joins them with the plan.

Defined cases: a null text counts as empty and holds the end id only; repeated
ids are packed row by row; a very long text is encoded whole and cut into as many
pieces as it needs; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.common import ranked, slices, stored
from siteledger.llm.tokens import encoder

SEQUENCE = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Which remaining capacities have an open sequence; finds the tightest."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, capacity: int, has: bool) -> None:
        k = self.size + capacity
        self.some[k] = has
        while k > 1:
            k >>= 1
            self.some[k] = self.some[2 * k] | self.some[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least need that has a sequence."""
        k = self.size + need
        if self.some[k]:
            return need
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, first, each, used): pieces lo to hi-1 of a length go,
    each to a sequence, into sequences from first on, behind used tokens."""
    tree = CapacityTree(size)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by capacity: first sequence, how many
    rows, made = [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            if not open_[capacity]:
                tree.set(capacity, True)
            open_[capacity].append((first, n))

    for length in sorted(counts, reverse=True):
        lo, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            each = (size if room is None else room) // length
            if room is None:
                room, first, n = size, made, -(-left // each)
                made += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            some = left - full * each if full < n else 0
            took = full * each + some
            rows.append((length, lo, lo + took, first, each, size - room))
            leave(room - each * length, first, full)
            if some:
                leave(room - some * length, first + full, 1)
            leave(room, first + full + (some > 0), n - full - (some > 0))
            lo, left = lo + took, left - took
    return rows


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer, "I", drops_space=True), end_id.to_bytes(4, "little"), 4 * size
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids += end
                for at in range(0, len(ids), step):
                    cut = ids[at : at + step]
                    out.append((doc_id, at // step, at // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces (with length, doc_id, piece) and sequence_id, offset."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    made = spark.createDataFrame(plan(counts, size), "__length long, __lo long, __hi long, __first long, __each long, __used long")
    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "start"], "__rank", parts=slices(spark))
    there = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    placed = numbered.join(F.broadcast(made), there)  # as many rows as lengths meet capacities, whatever the corpus
    nth = F.col("__rank") - F.col("__lo")
    return placed.select(*pieces.columns, (F.col("__first") + (nth / F.col("__each")).cast("long")).alias("sequence_id"), (F.col("__used") + nth % F.col("__each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents and their places, in as few sequences as found."""
    return pack(stored(encode_pieces(docs, tokenizer, end_id, size), "packing-pieces"), size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)
