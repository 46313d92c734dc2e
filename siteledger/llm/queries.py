"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteledger.llm.alignment import op11_alignment
from siteledger.llm.mixing import op8_mixing
from siteledger.llm.ngram_join import op1_ngram_join
from siteledger.llm.packing import op6_packing
from siteledger.llm.periodic_runs import op12_periodic_runs
from siteledger.llm.pitman_yor import op4_pitman_yor
from siteledger.llm.preferences import OP9_SQL, op9_preferences
from siteledger.llm.quality_outliers import op10_quality_outliers
from siteledger.llm.sharding import op2_sharding
from siteledger.llm.sorted_shards import op5_sorted_shards
from siteledger.llm.toxicity import op7_toxicity
from siteledger.llm.url_filter import OP13_SQL, op13_url_filter
from siteledger.llm.wand_search import OP3_SQL, op3_wand_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_wand_search": op3_wand_search,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_sorted_shards": op5_sorted_shards,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_preferences": op9_preferences,
    "op10_quality_outliers": op10_quality_outliers,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_wand_search": OP3_SQL,
    "op9_preferences": OP9_SQL,
    "op13_url_filter": OP13_SQL,
}
