"""Alignment of the tokens of two tokenizers (operator 11), with Arrow tables.

Each text is encoded by a byte-level file (A) and by a piece file (B). Tokens
cover byte ranges of the text, so both are partitions of one range: where tokens
of both end, groups end, and between two neighbouring ends of either lies one
overlap of one A token with one B token, a link.

A task works on batches of some megabytes. Id lists are flattened, with the
document of each id; byte lengths are summed up within documents; an Acero full
outer join of both sides on (document, end) gives every end once, and in order of
ends the next id of either side names the link. Table.group_by counts the links
of each pair of ids over a chunk of many documents. Spark adds the chunks' counts
up, finds each B id's highest, and sends a chunk the counts of its own pairs;
there each document looks its links up and adds.

What is shuffled: a row a chunk and distinct pair, twice, and the links of each
document as numbers of its chunk's pairs, once. A pair is at most once in a
chunk, so no pair weighs more than another by more than the number of chunks, and
all of a chunk is bounded by CHUNK_BYTES of text (or one longer text). The only
broadcast is one number a B id, at most the size of B's vocabulary.

Defined cases: a text that is null or empty, or whose tokens do not give back its
bytes after a space (it holds the mark that B writes for a space, say), has no
tokens and zeros; repeated ids and rows are aligned and counted row by row; ties
for the highest count are all best; an empty table gives an empty result; very
long texts are encoded and aligned whole, in a batch and chunk of their own;
columns other than doc_id and text are ignored, whatever their names; a null
doc_id is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.common import stored
from siteledger.llm.tokens import _BYTE_CHARS, Encoder, _Store

#: Bytes of text that one Arrow pipeline run holds, and that share pair counts.
BATCH_BYTES, CHUNK_BYTES = 1_000_000, 8_000_000
#: Documents of a chunk, so that empty ones do not pile up.
CHUNK_DOCS = 200_000
#: Pairs of a stored row.
ROW_PAIRS = 65_536
#: Parts of texts whose ids a worker keeps for each file.
CACHE = 100_000

MARK = "▁"  # how pieces write a space
_RUN = re.compile(r" +[^ ]*")


class PlainEncoder(Encoder):
    """Ids of a byte-level file; special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path, "H", False)
        self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:  # a smaller store than the plain encoder's: two files share a worker
            full = self.known
            full.old = {}
            self.known = _Store(self, full)
        return super().encode(texts)

    def token_bytes(self) -> list[bytes]:
        shown = {chr(c): b for b, c in _BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in _BYTE_CHARS}
        size = self.tokenizer.get_vocab_size()
        return [bytes(shown[c] for c in self.tokenizer.id_to_token(n)) for n in range(size)]


class PieceEncoder:
    """Ids of a piece file, which puts a space before a text.

    Where no piece of the file holds the space mark behind another character, no
    merge reaches from there over a space, so a text can be cut before such
    spaces and the ids of the parts, end to end, are those of the whole. A part
    is encoded without its first space, which the file adds again."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces) and MARK in self.pieces
        self.space = array("H", [self.pieces.index(MARK)]).tobytes() if self.cuts else b""
        self.known = {"": self.space}

    def token_bytes(self) -> list[bytes]:
        byte = re.compile("<0x([0-9A-F]{2})>")
        return [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in self.pieces]

    def whole(self, text: str) -> bytes:
        return array("H", self.model.encode(text, num_threads=1)).tobytes()

    def _parts(self, text: str) -> list[str]:
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in _RUN.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self.whole(text) for text in texts]
        if len(self.known) > CACHE:
            self.known = {"": self.space}
        known = self.known
        parts = [self._parts(text) if text else [] for text in texts]
        new = list(set().union(*parts).difference(known))
        for part, ids in zip(new, self.model.encode(new, num_threads=1)):
            known[part] = array("H", ids).tobytes()
        return [b"".join(map(known.__getitem__, p)) for p in parts]


@dataclass
class Vocabulary:
    """What alignment needs of one file: an encoder, and bytes and text of each id."""

    encoder: PlainEncoder | PieceEncoder
    token: pa.Array
    size: pa.Array
    text: pa.Array

    @classmethod
    def of(cls, encoder: PlainEncoder | PieceEncoder) -> Vocabulary:
        token = encoder.token_bytes()
        return cls(encoder, pa.array(token, pa.large_binary()), pa.array([len(t) for t in token], pa.int64()), pa.array([str(n) for n in range(len(token))], pa.large_string()))

    def encode(self, texts: list[str]) -> pa.ListArray:
        ids = self.encoder.encode(texts)
        places = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)])
        return pa.LargeListArray.from_arrays(places, np.frombuffer(b"".join(ids), np.uint16).astype(np.int32))

    def gives_back(self, ids: pa.ListArray, want: list[bytes]) -> np.ndarray:
        """Whether the tokens of each list are the bytes wanted, end to end."""
        joined = self.token.take(pc.list_flatten(ids))
        data = joined.buffers()[2]
        at = np.frombuffer(joined.buffers()[1], np.int64)[np.asarray(ids.offsets)] if len(joined) else np.zeros(len(want) + 1, np.int64)
        raw = memoryview(data).cast("B") if data is not None else memoryview(b"")
        return np.array([raw[i:j] == w for i, j, w in zip(at[:-1], at[1:], want)], bool)

    def ends(self, ids: pa.ListArray, name: str) -> pa.Table:
        """doc, end (bytes from the start of the document) and id of each token."""
        flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
        run = pc.cumulative_sum(self.size.take(flat))
        edges = np.asarray(ids.offsets)
        before = np.concatenate([[0], np.asarray(run)])[edges[:-1]]
        end = pc.subtract(run, pa.array(before).take(doc))
        return pa.table({"doc": doc, "end": end, name: flat})


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, kind: str) -> Vocabulary:
    """This process's vocabulary of a file; kind is bytes or pieces."""
    if (path, kind) not in _vocabularies:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _vocabularies[path, kind] = Vocabulary.of(PlainEncoder(path) if kind == "bytes" else PieceEncoder(path))
    return _vocabularies[path, kind]


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _rendered(ids: pa.Array, closes: np.ndarray, names: pa.Array) -> pa.Array:
    """The ids of each group, joined by commas; closes tells the last of a group."""
    places = np.concatenate([[0], np.flatnonzero(closes) + 1])
    return pc.binary_join(pa.LargeListArray.from_arrays(places, names.take(ids)), _text(","))


@dataclass
class Aligned:
    """One batch: columns of its documents, and the pair of each link in their order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    pairs: pa.Array


def align_texts(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> Aligned:
    """The alignment of each text, in order."""
    n = len(texts)
    tried = [k for k, t in enumerate(texts) if t and MARK not in t]
    want = [b" " + texts[k].encode() for k in tried]
    ids_a, ids_b = a.encode([" " + texts[k] for k in tried]), b.encode([texts[k] for k in tried])
    good = a.gives_back(ids_a, want) & b.gives_back(ids_b, want)
    if not good.all():
        keep = pa.array(np.flatnonzero(good))
        ids_a, ids_b = ids_a.take(keep), ids_b.take(keep)
    row = np.array(tried, np.int64)[good]

    both = a.ends(ids_a, "a").join(b.ends(ids_b, "b"), keys=["doc", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    col = {c: both[c].combine_chunks() if both[c].num_chunks != 1 else both[c].chunk(0) for c in both.column_names}
    in_a, in_b = np.asarray(col["a"].is_valid()), np.asarray(col["b"].is_valid())
    cut = in_a & in_b
    doc = np.asarray(col["doc"]).astype(np.int64)
    next_a, next_b = pc.fill_null_backward(col["a"]), pc.fill_null_backward(col["b"])
    pairs = pc.add(pc.shift_left(next_a.cast(pa.int64()), pa.scalar(16, pa.int64())), next_b.cast(pa.int64()))

    n_groups = np.bincount(doc[cut], minlength=len(row))
    groups = pc.binary_join_element_wise(_rendered(col["a"].drop_null(), cut[in_a], a.text), _rendered(col["b"].drop_null(), cut[in_b], b.text), _text("|"))
    places = np.concatenate([[0], np.cumsum(n_groups)])
    by_doc = pc.binary_join(pa.LargeListArray.from_arrays(places, groups), _text(";"))

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[row] = values
        return out

    place = np.full(n, len(row))
    place[row] = np.arange(len(row))
    shown = pa.concat_arrays([by_doc, pa.array([""], pa.large_string())]).take(pa.array(place))
    return Aligned(spread(np.diff(np.asarray(ids_a.offsets))), spread(np.diff(np.asarray(ids_b.offsets))), spread(n_groups), spread(np.bincount(doc, minlength=len(row))), shown, pairs)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


class _Chunk:
    """Documents that share one table of pair counts."""

    def __init__(self, number: int, kind: pa.DataType) -> None:
        self.number, self.kind = number, kind
        self.ids: list[pa.Array] = []
        self.parts: list[Aligned] = []
        self.tables: list[pa.Table] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, part: Aligned, size: int) -> None:
        self.ids.append(ids)
        self.parts.append(part)
        counted = pa.table({"pair": part.pairs}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
        self.tables.append(counted.rename_columns(["pair", "n"]))
        if len(self.tables) > 8:
            self.tables = [_summed(self.tables)]
        self.bytes += size
        self.docs += len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row a document, then the pairs and their counts."""
        if not self.ids:
            return
        table = _summed(self.tables).combine_chunks()
        pair = table["pair"].chunk(0) if table.num_rows else pa.array([], pa.int64())
        count = table["n"].chunk(0) if table.num_rows else pa.array([], pa.int64())
        for ids, p in zip(self.ids, self.parts):
            links = pc.index_in(p.pairs, value_set=pair)
            places = np.concatenate([[0], np.cumsum(p.n_links)]).astype(np.int32)
            yield self._batch(ids, [pa.array(x) for x in (p.n_a, p.n_b, p.n_groups, p.n_links)], p.groups.cast(pa.string()), pa.ListArray.from_arrays(places, links), None, None, None)
        for at in range(0, len(pair), ROW_PAIRS):
            one = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x)
            zeros = [pa.array([0], pa.int64())] * 4
            yield self._batch(pa.nulls(1, self.kind), zeros, pa.array([""]), None, [at], one(pair.slice(at, ROW_PAIRS)), one(count.slice(at, ROW_PAIRS)))

    def _batch(self, ids, numbers, groups, links, base, pairs, counts) -> pa.RecordBatch:
        n = len(ids)
        nulls = lambda x, kind: pa.nulls(n, kind) if x is None else x
        columns = [pa.array(np.full(n, self.number, np.int64)), ids, *numbers, groups, nulls(links, pa.list_(pa.int32())), pa.nulls(n, pa.int32()) if base is None else pa.array(base, pa.int32()), nulls(pairs, pa.list_(pa.int64())), nulls(counts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "base", "pairs", "counts"])


def _runs(column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """First row, rows and bytes of runs of about BATCH_BYTES."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        before = end[at] - size[at]
        to = max(at + 1, int(np.searchsorted(end, before + BATCH_BYTES, side="right")))
        yield at, to - at, int(end[to - 1] - before)
        at = to


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (base is null) and of their chunks' pairs and counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(a_path, "bytes"), vocabulary(b_path, "pieces")
        number = TaskContext.get().partitionId() << 32
        chunk = None
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for at, n, size in _runs(column):
                if chunk is None or (chunk.docs and (chunk.bytes + size > CHUNK_BYTES or chunk.docs + n > CHUNK_DOCS)):
                    if chunk is not None:
                        yield from chunk.rows()
                    chunk = _Chunk(number, ids.type)
                    number += 1
                chunk.add(ids.slice(at, n), align_texts(column.slice(at, n).to_pylist(), a, b), size)
        if chunk is not None:
            yield from chunk.rows()

    columns = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<int>, base int, pairs array<long>, counts array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {kind}, {columns}")


def align(docs: DataFrame, a_path: str, b_path: str, groups: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables from docs (doc_id, text): by document doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum and groups, with the ids of each group written as
    a1,a2|b1;a3|b2,b3; and a, b, count of every pair of linked ids.

    groups: what to keep of the written groups, an expression over groups."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shown = F.col("groups") if groups is None else groups
    chunks = stored(aligned_chunks(docs, a_path, b_path).withColumn("groups", F.when(F.col("n_a") > 0, shown).otherwise("")), "alignment-chunks")
    rows = chunks.filter("base IS NULL").drop("base", "pairs", "counts")
    each = chunks.filter("base IS NOT NULL").select(F.col("chunk").alias("of"), "base", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    each = each.select("of", (F.col("base") + F.col("at")).alias("number"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = stored(each.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts").withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFF)))
    best = counts.groupBy("b").agg(F.max("count").alias("__best"))  # a row an id of B
    judged = counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("__best")).alias("best"))
    told = each.select("of", "number", "pair").join(judged, "pair").select("of", "number", "count", "best")

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        number = np.asarray(right["number"])
        count, top = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], top[number] = np.asarray(right["count"]), np.asarray(right["best"]).astype(np.int64)
        links = np.asarray(pc.list_flatten(left["links"]))
        edges = np.concatenate([[0], np.cumsum(np.asarray(left["n_links"]))])
        sums = [np.concatenate([[0], np.cumsum(x[links])]) for x in (top, count)]
        out = left.select(names)
        for name, s in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(s[edges[1:]] - s[edges[:-1]]))
        return out

    by_doc = rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return by_doc, counts.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("b").cast("int").alias("b"), "count")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_doc, _ = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), F.sha2("groups", 256))
    return by_doc.withColumnRenamed("groups", "groups_sha256").select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
