"""The queries of this subpackage, one for each operator, and SQL of the same rows where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import byte_bpe, exact_dedup, jaccard_join, katz, mixing, sharding, token_counts, token_store, toxicity, vector_search

NAMED = (exact_dedup.op1_exact_dedup, token_counts.op2_token_counts, byte_bpe.op3_byte_bpe, token_store.op4_token_store, sharding.op5_sharding, jaccard_join.op6_ngram_jaccard, katz.op7_katz_lm, vector_search.op8_anisotropic_ann, toxicity.op9_toxicity, mixing.op10_source_mixing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMED}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL}
