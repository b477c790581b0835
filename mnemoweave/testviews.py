"""The driver's tables seen as a memory graph, in Spark and in SQL.

Orders are chunks, customers their documents, parts the entities, and parts of one order co-occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.functions import edge_weight
from mnemoweave.operators.relations import cooccurrences
from mnemoweave.state import GraphState

_TYPES = {"1-URGENT": "Decision", "2-HIGH": "ActionItem", "3-MEDIUM": "StatusUpdate", "4-NOT SPECIFIED": "Discussion"}
_CATEGORIES = {"F": "Episodic", "O": "Semantic"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(c: str, values: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def graph(spark: SparkSession, sf_dir: str) -> GraphState:
    line, order, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    lines = F.array_sort(F.collect_list(F.struct(F.coalesce("l_linenumber", F.lit(2**31 - 1)).alias("n"), "l_partkey")))  # a part stands where its first line does
    tags = line.groupBy("l_orderkey").agg(F.transform(F.array_distinct(F.transform(lines, lambda x: x["l_partkey"])), lambda p: F.concat(F.lit("p"), p)).alias("tags"))
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))  # sessions run in UTC
    chunks = order.join(tags, order["o_orderkey"] == tags["l_orderkey"], "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("cust-"), "o_custkey").alias("source_document"),
        F.lit(None).cast("string").alias("section_name"),
        F.lit(None).cast("string").alias("speaker"),
        F.when(F.col("o_orderkey") % 11 != 0, seconds).alias("timestamp"),
        _named("o_orderpriority", _TYPES, "Background").alias("chunk_type"),
        _named("o_orderstatus", _CATEGORIES, "Procedural").alias("memory_category"),
        F.concat_ws(" ", F.lit("order"), "o_orderpriority", F.lit("of"), "o_custkey").alias("text"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        seconds.alias("created_at"),
        F.array(F.concat(F.lit("project-"), (F.col("o_custkey") % 7).cast("string"))).alias("projects"),
    )
    mentions = tags.select(F.explode("tags").alias("entity_id"), F.col("l_orderkey").cast("string").alias("chunk_id"))
    met = chunks.select(F.explode("tags").alias("entity_id"), "source_document", "created_at")
    documents = met.select("entity_id", F.col("source_document").alias("document")).distinct()
    seen = met.groupBy("entity_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("access_count"))
    key = F.col("p_partkey")
    entities = part.select(F.concat(F.lit("p"), key).alias("id"), F.concat_ws(" ", "p_name", key).alias("canonical_name"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("entity_type"), F.array(F.concat(F.lit("size-"), (F.col("p_size") % 5).cast("string"))).alias("projects"))
    entities = entities.join(seen, entities["id"] == seen["entity_id"], "left").select(
        "id", "canonical_name", "aliases", "entity_type", F.coalesce("created_at", F.lit(0)).alias("created_at"), F.coalesce("updated_at", F.lit(0)).alias("updated_at"),
        F.coalesce("access_count", F.lit(0)).alias("access_count"), F.lit(0.0).alias("rank"), F.lit(None).cast("double").alias("extraction_confidence"),
        F.array().cast("array<struct<merged_entity_id:string,merged_entity_name:string,method:string,merged_at:bigint,confidence:double>>").alias("merge_history"), "projects",
    )
    hashes = chunks.select(F.col("source_document").alias("document")).distinct().withColumn("sha256", F.sha2("document", 256))
    return GraphState(entities, mentions, documents, cooccurrences(chunks, edge_weight), chunks, hashes)


#: The same graph as common table expressions for DuckDB.
SQL = """WITH tag AS (
  SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL
), tags AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS chunk_id, 'p' || l_partkey AS tag, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) AS pos FROM tag
), chunks AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'cust-' || o_custkey AS source_document,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS "timestamp",
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Decision' WHEN '2-HIGH' THEN 'ActionItem' WHEN '3-MEDIUM' THEN 'StatusUpdate' WHEN '4-NOT SPECIFIED' THEN 'Discussion' ELSE 'Background' END AS chunk_type,
    CASE o_orderstatus WHEN 'F' THEN 'Episodic' WHEN 'O' THEN 'Semantic' ELSE 'Procedural' END AS memory_category,
    concat_ws(' ', 'order', o_orderpriority, 'of', o_custkey) AS text, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, 'project-' || (o_custkey % 7) AS project
  FROM orders
), mentions AS (
  SELECT 'p' || l_partkey AS entity_id, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM tag
), entity_documents AS (
  SELECT DISTINCT entity_id, source_document AS document FROM mentions JOIN chunks ON chunk_id = id
), seen AS (
  SELECT entity_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS access_count FROM mentions JOIN chunks ON chunk_id = id GROUP BY entity_id
), entities AS (
  SELECT 'p' || p_partkey AS id, p_name || ' ' || p_partkey AS canonical_name, p_brand AS alias, p_type AS entity_type, coalesce(created_at, 0) AS created_at,
    coalesce(updated_at, 0) AS updated_at, coalesce(access_count, 0) AS access_count, 'size-' || (p_size % 5) AS project
  FROM part LEFT JOIN seen ON entity_id = 'p' || p_partkey
), edges AS (
  SELECT a.tag AS src, b.tag AS dst, c.id AS chunk_id, c.chunk_type, c."timestamp", c.source_document,
    CASE c.chunk_type WHEN 'Decision' THEN 2.0::DOUBLE WHEN 'ActionItem' THEN 1.8::DOUBLE WHEN 'StatusUpdate' THEN 1.5::DOUBLE WHEN 'Background' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM tags a JOIN tags b ON a.chunk_id = b.chunk_id AND a.tag <> b.tag JOIN chunks c ON c.id = a.chunk_id
)
"""
