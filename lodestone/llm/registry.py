"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, language, language_model, licenses, minhash, packing, sharding, toxicity, trie, urls, warc, whitening
from .common import apart

_ALL = {
    "op1_decontaminate": (decontaminate.op1_decontaminate, decontaminate.ORACLE),
    "op2_deleted_interpolation": (language_model.op2_deleted_interpolation, language_model.ORACLE),
    "op3_hilbert_packing": (packing.op3_hilbert_packing, None),
    "op4_license_scan": (licenses.op4_license_scan, licenses.ORACLE),
    "op5_warc_round_trip": (warc.op5_warc_round_trip, warc.ORACLE),
    "op6_sample_splitter_sharding": (sharding.op6_sample_splitter_sharding, sharding.ORACLE),
    "op7_product_quantised_near_dedup": (embeddings.op7_product_quantised_near_dedup, embeddings.ORACLE),
    "op8_factorization_machine_toxicity": (toxicity.op8_factorization_machine_toxicity, None),
    "op9_subword_language_id": (language.op9_subword_language_id, None),
    "op10_minhash_near_dedup": (minhash.op10_minhash_near_dedup, minhash.ORACLE),
    "op11_randomised_whitening": (whitening.op11_randomised_whitening, whitening.ORACLE),
    "op12_bloom_url_filter": (urls.op12_bloom_url_filter, urls.ORACLE),
    "op13_conversation_prefix_trie": (trie.op13_conversation_prefix_trie, trie.ORACLE),
}


def _apart(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apart(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query runs in a session of its own, so the caller's keeps its settings."""
    return {name: _apart(query) for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
