"""Token ids in sorted-string-table shards (operator 5).

A shard holds the documents of one range of ids in ascending order:

    magic | block ... block | Bloom filter | block index | footer

A block holds about BLOCK bytes of entries. An entry's key is stored as what it
shares with the key before it and the rest; every RESTART-th key is stored
whole and its place listed at the end of the block, so a key is found by binary
search over restarts. The index has the last key, place, size and checksum of
each block. The footer, of fixed size and last in the file, says where filter
and index are. A lookup reads footer, filter, index and one block.

Each task streams one range to one file in the shared folder and reports it in
a manifest; files of failed attempts are in no manifest. Reading back starts
from the manifest, a file a task.

Defined cases: a null text counts as empty and holds the end id only; rows with
a null id sort first; rows that share an id follow each other in the order of a
hash of their text; an empty table makes no file and an empty result; a
very long text is encoded whole and is one entry of a block of its own size; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteledger.llm.common import shared_dir, slices, stored
from siteledger.llm.tokens import encoder

MAGIC = b"SLEDGST1"
BLOCK = 65_536
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
_FOOTER = struct.Struct("<QQQQQQB")
_CODES = {"H": 2, "I": 4}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    """Bytes that sort as (null first, doc_id, nth)."""
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", nth)
    return b"\1" + struct.pack(">QI", doc_id + 2**63, nth)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - 2**63 if key[0] else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


@dataclass
class ShardWriter:
    """Streams entries in ascending key order to a file that is open for writing."""

    out: object
    width: int
    at: int = 0
    n_docs: int = 0
    n_ids: int = 0
    keys: list[bytes] = field(default_factory=list)
    index: list[bytes] = field(default_factory=list)
    block: bytearray = field(default_factory=bytearray)
    restarts: list[int] = field(default_factory=list)
    in_block: int = 0
    last: bytes = b""

    def __post_init__(self) -> None:
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART:
            while self.last[shared] == key[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        self.n_docs += 1
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self.in_block:
            b = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QII", self.at, len(b), zlib.crc32(b)))
            self._put(b)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._close_block()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, dtype=np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(struct.pack("<Q", bits) + bloom.tobytes())
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(_FOOTER.pack(bloom_at, index_at, self.at, len(self.index), self.n_docs, self.n_ids, self.width) + MAGIC)


def _entries(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    (n,) = struct.unpack_from("<I", block, len(block) - 4)
    end, key = len(block) - 4 * (n + 1), b""
    while at < end:
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        at += rest
        yield key, block[at : at + size]
        at += size


class ShardReader:
    """Scans a shard, or finds one document in it. source: a seekable binary file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = self._get(size - _FOOTER.size - len(MAGIC), _FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or one cut short")
        self.bloom_at, self.index_at, self.index_end, self.n_blocks, self.n_docs, self.n_ids, self.width = _FOOTER.unpack(tail[: -len(MAGIC)])
        raw, at = self._get(self.index_at, self.index_end - self.index_at), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        for _ in range(self.n_blocks):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QII", raw, at + n)))
            at += n + 16

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> bytes:
        _, at, n, crc = self.index[k]
        b = self._get(at, n)
        if zlib.crc32(b) != crc:
            raise ValueError(f"block {k} is damaged")
        return b

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(self.n_blocks):
            yield from _entries(self._block(k))

    def might_hold(self, doc_id: int | None) -> bool:
        raw = self._get(self.bloom_at, self.index_at - self.bloom_at)
        (bits,) = struct.unpack_from("<Q", raw)
        return all(raw[8 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key_of(doc_id), bits))

    def find(self, doc_id: int | None) -> list[bytes]:
        """The values of all rows with this id, by filter and binary search."""
        if not self.might_hold(doc_id):
            return []
        low, found = key_of(doc_id), []
        a, b = 0, self.n_blocks
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.index[m][0] < low else (a, m)
        for k in range(a, self.n_blocks):
            block = self._block(k)
            (n,) = struct.unpack_from("<I", block, len(block) - 4)
            places = struct.unpack_from(f"<{n}I", block, len(block) - 4 * (n + 1))
            x, y = 0, n
            while y - x > 1:
                m = (x + y) // 2
                x, y = (m, y) if next(_entries(block, places[m]))[0] <= low else (x, m)
            for key, value in _entries(block, places[x]):
                if key[:9] == low[:9]:
                    found.append(value)
                elif key > low:
                    return found
        return found


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, code: str = "H", parts: int | None = None) -> DataFrame:
    """Encodes doc_id, text into shards below folder; gives the stored manifest.

    Ranges of ids are dealt to parts; within one, rows are sorted by Spark and
    streamed. code: H for ids below 65536 (two bytes each), I for any."""
    spark = docs.sparkSession
    n = parts or slices(spark)
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    end = b"" if end_id is None else end_id.to_bytes(_CODES[code], "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.sst"
        shard = stream = None
        enc, last, nth = encoder(tokenizer, code), b"", 0
        for b in batches:
            if b.num_rows and shard is None:
                system, local = _open(path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(local)
                shard = ShardWriter(stream, _CODES[code])
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                key = key_of(doc_id)
                nth = nth + 1 if key == last else 0
                last = key
                shard.add(key_of(doc_id, nth), ids + end)
        if shard:
            shard.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([shard.n_docs]), pa.array([shard.n_ids])], names=["part", "path", "n_docs", "n_ids"])

    return stored(rows.mapInArrow(run, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document, over all shards), n_tokens and
    ids_crc32 (of the ids as unsigned 32-bit integers) of every entry."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"), "part")  # one short row a shard
    files = files.repartition(max(slices(manifest.sparkSession), 1), "part").select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, local = _open(path)
                with system.open_input_file(local) as f:
                    shard = ShardReader(f)
                    kind, at = ("<u2" if shard.width == 2 else "<u4"), base
                    out: list[tuple] = []
                    for key, value in shard.scan():
                        ids = np.frombuffer(value, kind)
                        out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    cols = zip(*out) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, folder))
