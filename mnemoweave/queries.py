"""The registered queries over the graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemoweave.catalog import graph_queries, scalar_queries, state_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (graph_queries, text_queries, state_queries, scalar_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["j2_cooccurrences_agg"](spark, sf_dir)
