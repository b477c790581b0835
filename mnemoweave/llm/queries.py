"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemoweave.llm import bpe, decontaminate, importance, language_id, line_dedup, prefix_trie, quality, sharding, simhash_dedup, substring_dedup, topk, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.query,
        "op2_line_dedup": line_dedup.query,
        "op3_language_id": language_id.query,
        "op4_decontaminate": decontaminate.query,
        "op5_substring_dedup": substring_dedup.query,
        "op6_toxicity": toxicity.query,
        "op7_exact_topk": topk.query,
        "op8_bpe": bpe.query,
        "op9_simhash_near_dedup": simhash_dedup.query,
        "op10_quality": quality.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_importance_resampling": importance.query,
        "op13_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op7_exact_topk": topk.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
    }
