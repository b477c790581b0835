"""A graph in SQL: its tables as temporary views, its lookups as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mnemoweave.state import GraphState

#: name: (parameters, columns, query over the views); ``{p}`` stands for the prefix of the views.
LOOKUPS = {
    "entities_named": ("wanted STRING", "id STRING, canonical_name STRING, entity_type STRING", "SELECT id, canonical_name, entity_type FROM {p}entities WHERE lower(canonical_name) = lower(wanted) OR exists(aliases, a -> lower(a) = lower(wanted))"),
    "cooccurrences_of": ("entity STRING", "neighbor STRING, n BIGINT, weight DOUBLE", "SELECT dst, count(*), sum(weight) FROM {p}edges WHERE src = entity GROUP BY dst"),
    "chunks_of": ("entity STRING", "id STRING, source_document STRING, chunk_type STRING, at BIGINT, text STRING", "SELECT c.id, c.source_document, c.chunk_type, coalesce(c.`timestamp`, c.created_at), c.text FROM {p}chunks c LEFT SEMI JOIN (SELECT chunk_id FROM {p}mentions WHERE entity_id = entity) m ON c.id = m.chunk_id"),
    "evidence_between": ("one STRING, other STRING", "chunk_id STRING, source_document STRING, chunk_type STRING", "SELECT DISTINCT chunk_id, source_document, chunk_type FROM {p}edges WHERE (src = one AND dst = other) OR (src = other AND dst = one)"),
    "documents_of": ("entity STRING", "document STRING", "SELECT document FROM {p}entity_documents WHERE entity_id = entity"),
}


def register(spark: SparkSession, state: GraphState, prefix: str = "memory_") -> list[str]:
    """Make ``<prefix><table>`` views and ``<prefix><lookup>(...)`` table functions; their names.

    Lookups are SQL themselves: they are planned into the query that calls them.
    """
    for name, df in state._asdict().items():
        df.createOrReplaceTempView(prefix + name)
    for name, (parameters, columns, query) in LOOKUPS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {query.format(p=prefix)}")
    return [prefix + n for n in (*state._asdict(), *LOOKUPS)]
