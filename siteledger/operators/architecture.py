"""Site architecture: slow templates, near-duplicate articles, missing region pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siteledger.functions.automaton import Automaton, string_bytes
from siteledger.functions.scalars import fixed
from siteledger.operators.findings import union
from siteledger.operators.metrics import HISTORY_DAYS, recent

MIN_RUNS, LOW_SCORE, MIN_IMPRESSIONS = 3, 50, 500


def template_history(audits: DataFrame, min_runs: int = MIN_RUNS, order: str = "run_at") -> DataFrame:
    """url and its scores in the order of runs, for urls with enough of them."""
    rows = audits.filter("performance_score is not null")
    runs = rows.groupBy("url").agg(F.array_sort(F.collect_list(F.struct(order, "id", "performance_score"))).alias("r"))
    return runs.filter(F.size("r") >= min_runs).select("url", F.transform("r", lambda x: x["performance_score"]).alias("scores"))


def slow_templates(history: DataFrame) -> DataFrame:
    return history.filter(F.forall("scores", lambda s: s < LOW_SCORE))


def _terms_in(texts: DataFrame, column: str, terms: DataFrame, by_word: bool) -> DataFrame:
    """The rows of texts with each term that their column contains. One automaton
    of all terms, built once a task, goes over each text once, however many terms
    there are; the terms are a dimension that a process holds. by_word: only where
    no letter a-z or digit is beside the term."""
    words = sorted({r.term for r in terms.select("term").distinct().collect() if r.term})
    inner = np.zeros(257, bool)  # the last place: beyond a text's end
    inner[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = Automaton(words), pa.array(words, pa.string())
        for batch in batches:
            data, offsets = string_bytes(batch.column(column))
            row, term, start = automaton.matches(data, offsets)
            if by_word:
                end = start + automaton.sizes[term]
                padded = np.append(data.astype(np.int64), 256)
                before = np.where(start > offsets[row], padded[start - 1], 256)
                after = np.where(end < offsets[row + 1], padded[end], 256)
                alone = ~inner[before] & ~inner[after]
                row, term = row[alone], term[alone]
            found = np.unique(row * max(len(words), 1) + term)
            taken = batch.take(pa.array(found // max(len(words), 1)))
            yield pa.RecordBatch.from_arrays([*taken.columns, names.take(pa.array(found % max(len(words), 1)))], [*taken.schema.names, "term"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("term", StringType())]))


def term_matches(snapshot: DataFrame, terms: DataFrame, by_word: bool = False) -> DataFrame:
    """q, impressions and term of every query that contains the term. Queries
    repeat, so impressions are summed by query before terms are looked for."""
    per = snapshot.groupBy(F.lower("query").alias("q")).agg(F.sum("impressions").alias("impressions"))
    return _terms_in(per, "q", terms, by_word)


def missing_templates(snapshot: DataFrame, slugs: DataFrame, terms: DataFrame, as_of: dt.date, at_least: int = MIN_IMPRESSIONS, by_word: bool = False) -> DataFrame:
    """term and impressions of terms that are searched for and in no slug; only
    which of them occur comes back from the slugs."""
    asked = term_matches(recent(snapshot, as_of, HISTORY_DAYS), terms, by_word).groupBy("term").agg(F.sum("impressions").alias("impressions"))
    present = _terms_in(slugs.select(F.lower("slug").alias("slug")), "slug", terms, False).select("term").distinct()
    return asked.filter(F.col("impressions") >= at_least).join(present, "term", "left_anti")


def architecture_findings(templates: DataFrame, pairs: DataFrame, missing: DataFrame) -> DataFrame:
    def rows(df: DataFrame, kind: str, key, title, detail, ref) -> DataFrame:
        return df.select(F.lit("siteArchitecture").alias("source"), F.lit(kind).alias("finding_type"), F.concat_ws(":", F.lit(kind), key).alias("stable_key_input"), title.alias("title"), detail.alias("detail"), ref.alias("source_ref_id"))

    t, d, m = ("site-architecture-template-performance", "site-architecture-near-duplicate", "site-architecture-missing-template")
    both = F.concat_ws(":", "slug_a", "slug_b")
    scores = F.array_join(F.transform("scores", lambda s: s.cast("string")), ", ")
    return union(
        rows(slow_templates(templates), t, F.col("url"), F.concat(F.lit("Rendimiento consistentemente bajo en "), "url", F.lit(" (últimas puntuaciones: "), scores, F.lit(")")), F.to_json(F.struct("url", "scores")), F.col("url")),
        rows(pairs, d, both, F.concat(F.lit("Posible contenido casi duplicado: "), "slug_a", F.lit(" / "), "slug_b", F.lit(" (similitud "), fixed(F.col("similarity"), 2), F.lit(")")), F.to_json(F.struct(F.col("slug_a").alias("slugA"), F.col("slug_b").alias("slugB"), "similarity")), both),
        rows(missing, m, F.col("term"), F.concat(F.lit('"'), "term", F.lit('" tiene '), F.col("impressions").cast("string"), F.lit(" impresiones sin página provincial dedicada")), F.to_json(F.struct(F.col("term").alias("province"), "impressions")), F.col("term")),
    )
