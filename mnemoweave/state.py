"""The memory graph as immutable tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from mnemoweave import schemas


class GraphState(NamedTuple):
    """Every operator reads it; every mutation returns a new one."""

    entities: DataFrame
    mentions: DataFrame
    entity_documents: DataFrame
    edges: DataFrame
    chunks: DataFrame
    document_hashes: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> GraphState:
        make = lambda s: spark.createDataFrame([], s)
        return GraphState(make(schemas.ENTITIES), make(schemas.MENTIONS), make(schemas.ENTITY_DOCUMENTS), make(schemas.EDGES), make(schemas.CHUNKS), make(schemas.DOCUMENT_HASHES))
