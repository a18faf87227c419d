"""The queries of this subpackage and, where SQL can express them, the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.chat import ORACLE as CHAT_ORACLE, op8_chat_tree
from lorekeep.llm.embeddings import op10_cover_tree
from lorekeep.llm.language import op3_language_id
from lorekeep.llm.minhash import op7_minhash
from lorekeep.llm.mixing import op6_mixing
from lorekeep.llm.packing import op5_packing
from lorekeep.llm.periods import op12_periodic_runs
from lorekeep.llm.phrases import op11_phrases
from lorekeep.llm.sharding import op13_kd_shards
from lorekeep.llm.simhash import op9_simhash
from lorekeep.llm.substrings import op2_suffix_dedup
from lorekeep.llm.urls import op4_url_filter, oracle as url_oracle
from lorekeep.llm.warc import ORACLE as WARC_ORACLE, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_chat_tree": op8_chat_tree,
    "op9_simhash": op9_simhash,
    "op10_cover_tree": op10_cover_tree,
    "op11_phrases": op11_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_kd_shards": op13_kd_shards,
}
ORACLES: dict[str, str] = {
    "op1_warc": WARC_ORACLE,
    "op4_url_filter": url_oracle(),
    "op8_chat_tree": CHAT_ORACLE,
}
