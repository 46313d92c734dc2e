"""A corpus from raw documents to packed training sequences, in five stages.

Each stage works on all rows that the stage before it kept, and all but the last
return the columns of documents. SQL cannot express the learned and iterative
stages, so there is no oracle; tests compare with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteledger.llm.common import stored
from siteledger.llm.mixing import mixed_documents
from siteledger.llm.ngram_join import deduplicated
from siteledger.llm.packing import pack_documents
from siteledger.llm.quality_outliers import reject_outliers
from siteledger.llm.toxicity import drop_toxic

#: Near copies: five-word shingles, similarity of 80 percent.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
END_ID = 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches one half."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the outlier test reject."""
    return reject_outliers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return deduplicated(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source up to its target; a row for each draw of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all draws and their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
