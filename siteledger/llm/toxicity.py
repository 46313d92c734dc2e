"""Toxicity by multiple-instance learning (operator 7).

A document is a bag of sentences. Each sentence gets a logistic score from the
words and the four-byte pieces of words in it; the document's score is the
noisy-or of its sentences, so one offending sentence is enough. Only document
labels are known in training; the learned sentence scores then point at the
offending sentences.

Training uses at most MAX_TRAIN labelled documents (those with the smallest id
hash). Features live in a hashed space of FEATURES slots; a first pass counts
documents by slot, a second one reads only the MAX_USED slots that tell the
labels apart best. The number of training documents is bounded, their length is
not: whole texts are read, and one task learns from the used slots of their
sentences, 8 bytes each. The table of weights that every task gets has at most
MAX_USED entries. Scoring reads every whole text, in steps of bounded bytes (a
longer single text is one step).

Defined cases: a null or empty text has no sentence and gets the score of an
empty bag, 0; a null id is scored like any other row (held_out is null);
repeated ids are scored row by row; conflicting labels of one id count as the
larger; with no usable label every score is 0; all sentences of a very long text
are scored; extra columns pass through `drop_toxic` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from siteledger.llm.common import row_key, sheltered, stored
from siteledger.llm.textops import LOWER, WHITESPACE, Texts, mix, span_hashes, spans, texts

MAX_TRAIN = 16_000
BITS = 20
FEATURES = 1 << BITS
MAX_USED = 8_192
#: A slot is used if it occurs in so many training documents, and if labels
#: differ between documents with and without it by so many standard errors.
MIN_DOCS = 4
MIN_Z = 2.0
ROUNDS = 120
RATE = 0.3
L1 = 1e-4
THRESHOLD = 0.5

_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[list(b".!?\n")] = True
_WORD_BREAK = WHITESPACE.copy()
_WORD_BREAK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Used slots in ascending order, their weights, and the bias of a sentence."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _slots(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Slot and byte position of each word and of each four bytes inside a word."""
    ws, we, _ = spans(t, _WORD_BREAK)
    words = mix(span_hashes(t, ws, we, True)) >> np.uint64(64 - BITS)
    n = len(t.data) - 3
    if n <= 0:
        return words.astype(np.int64), ws
    low, inside = LOWER[t.data].astype(np.uint32), ~_WORD_BREAK[t.data]
    ok = inside[:n] & inside[1 : n + 1] & inside[2 : n + 2] & inside[3:]
    for back in (1, 2, 3):  # no piece reaches into the next text
        at = t.offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    four = low[:n] | (low[1 : n + 1] << 8) | (low[2 : n + 2] << 16) | (low[3:] << 24)
    at = np.flatnonzero(ok)
    pieces = ((four[at].astype(np.uint64) + np.uint64(1)) * _SPREAD) >> np.uint64(64 - BITS)
    return np.concatenate([words, pieces]).astype(np.int64), np.concatenate([ws, at])


def _hits(t: Texts, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (sentence, entry of table) once; start, end and text of each sentence.

    table has a number from 0 for each used slot and -1 elsewhere."""
    slots, at = _slots(t)
    ss, se, so = spans(t, _SENTENCE_END)
    used = table[slots]
    found = np.flatnonzero(used >= 0)
    size = int(table.max(initial=0)) + 1
    pair = np.unique((np.searchsorted(ss, at[found], side="right") - 1) * size + used[found])
    return pair // size, pair % size, ss, se, so


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _telling_slots(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The used slots, and the share of toxic documents in sample (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for t in texts(b.column(1)):
                slots, at = _slots(t)
                owner = np.searchsorted(t.offsets, at, side="right") - 1
                pair = np.unique(owner * FEATURES + slots)
                n += np.bincount(pair % FEATURES, minlength=FEATURES + 1)
                toxic += np.bincount(pair % FEATURES, weights=y[t.first + pair // FEATURES], minlength=FEATURES + 1).astype(np.int64)
            n[FEATURES] += len(y)
            toxic[FEATURES] += y.sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(toxic[some])], names=["slot", "n", "toxic"])

    counts = sample.mapInArrow(run, "slot long, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total = counts.filter(F.col("slot") == FEATURES).select("n", "toxic").first()
    if not total or not 0 < total.toxic < total.n:
        return np.zeros(0, np.int64), 0.0
    rate = total.toxic / total.n
    z = F.abs(F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counts.filter((F.col("slot") < FEATURES) & (F.col("n") >= MIN_DOCS) & (z >= MIN_Z)).orderBy(z.desc(), "slot").limit(MAX_USED).select("slot")
    return np.sort(best.toArrow()["slot"].to_numpy()), rate


def fit(labelled: DataFrame) -> Model:
    """Learns from rows (text, toxic), a bounded number of them, by gradient steps
    on the noisy-or likelihood of the document labels, with a sparsity penalty."""
    sample = stored(labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").filter("toxic in (0, 1)"), "toxicity-sample")
    slots, rate = _telling_slots(sample)
    if not len(slots):
        return Model(slots, np.zeros(0), -40.0)
    table = np.full(FEATURES, -1, dtype=np.int32)
    table[slots] = np.arange(len(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                s, f, ss, _, so = _hits(t, table)
                cut, first = np.searchsorted(so[s], np.arange(len(t) + 1)), np.searchsorted(so, np.arange(len(t) + 1))
                own = list(zip(cut[:-1], cut[1:], first[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[t.first : t.first + len(t)], pa.array(np.diff(first)), pa.array([(s[i:j] - k).astype("<i4").tobytes() for i, j, k in own]), pa.array([f[i:j].astype("<i4").tobytes() for i, j, _ in own])],
                    names=["toxic", "n", "s", "f"],
                )

    # A bounded number of documents: one task learns from all of them.
    rows = sample.mapInArrow(run, "toxic int, n long, s binary, f binary").repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, n, s, f = [], [], [], []
        for b in batches:
            y.append(b.column(0).to_numpy().astype(float))
            n.append(b.column(1).to_numpy())
            s += [np.frombuffer(x.as_py(), "<i4") for x in b.column(2)]
            f += [np.frombuffer(x.as_py(), "<i4") for x in b.column(3)]
        n = np.concatenate(n)
        base = np.cumsum(n) - n
        s = np.concatenate([x + np.int32(k) for x, k in zip(s, base)])
        weights, bias = _descend(np.concatenate(y), np.repeat(np.arange(len(n)), n), s, np.concatenate(f), len(slots), rate)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots[used], -1)), pa.array(np.append(weights[used], bias))], names=["slot", "weight"])

    learned = rows.mapInArrow(learn, "slot long, weight double").toArrow()  # a row a used slot
    slot, weight = learned["slot"].to_numpy(), learned["weight"].to_numpy()
    return Model(slot[slot >= 0], weight[slot >= 0], float(weight[slot < 0][0]))


def _descend(y: np.ndarray, d: np.ndarray, s: np.ndarray, f: np.ndarray, size: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias for labels y, documents d of sentences, and pairs (s, f)
    of sentence and entry."""
    weights, bias = np.zeros(size), float(np.log(rate / 10))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        score = bias + np.bincount(s, weights=weights[f], minlength=len(d))
        total = np.bincount(d, weights=_softplus(score), minlength=len(y))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
        g = pull[d] / (1 + np.exp(-score)) / len(y)
        gw, gb = np.bincount(f, weights=g[s], minlength=size), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / down) + 1e-6)
        weights = weights - scale * m / up
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * L1, 0)
        bias -= RATE * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return weights, bias


OFFENDING = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))


def with_score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", locate: bool = False) -> DataFrame:
    """The columns in keep and score; with locate, also offending: the sentences
    whose own score reaches one half, as byte ranges of the text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most MAX_USED slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = np.full(FEATURES, -1, dtype=np.int32)
        table[m.slots] = np.arange(len(m.slots))
        for b in batches:
            out = np.zeros(b.num_rows)
            found: list[list] = [[] for _ in range(b.num_rows)]
            for t in texts(b.column(at)):
                s, f, ss, se, so = _hits(t, table)
                z = m.bias + np.bincount(s, weights=m.weights[f], minlength=len(ss))
                total = np.bincount(so, weights=_softplus(z), minlength=len(t))
                out[t.first : t.first + len(t)] = -np.expm1(-total)
                for k in np.flatnonzero(z >= 0) if locate else ():
                    lo = t.offsets[so[k]]
                    found[t.first + so[k]].append({"start": int(ss[k] - lo), "end": int(se[k] - lo), "score": float(1 / (1 + np.exp(-z[k])))})
            cols, names = [*b.columns[: len(keep)], pa.array(out)], [*keep, "score"]
            if locate:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kept = docs.select(*keep, *([] if text in keep else [text]))
    at = kept.columns.index(text)
    more = [StructField("score", DoubleType()), StructField("offending", OFFENDING)]
    return kept.mapInArrow(run, StructType(kept.schema.fields[: len(keep)] + more[: 1 + locate]))


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows of docs outside the held-out fold: all, or those
    MAX_TRAIN whose ids have the smallest hashes."""
    marks = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    ids = marks.join(docs.select("doc_id").distinct(), "doc_id").filter(~held_out())
    ids = stored(ids.orderBy(row_key("doc_id"), "doc_id").limit(MAX_TRAIN), "toxicity-ids")  # a bounded number of short rows
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return fit(rows.select("text", F.col("__toxic").alias("toxic")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD; all columns stay.

    Rows are judged one by one, so rows that share an id can part.
    """
    model = fit_on(docs, labels)
    return sheltered(docs, lambda d: with_score(d, model, d.columns).filter(F.col("score") < THRESHOLD).drop("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_score(docs, model, ["doc_id"], locate=True)
    where = F.transform("offending", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join(where, "|").alias("offending"))
