"""Joins over the graph's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweave.state import GraphState
from mnemoweave.storage import materialise, narrow


def cooccurrences(chunks: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """Two directed edges for each pair of tag positions of a chunk that hold different entities.

    Pairs are made from the row of their chunk: no shuffle, and a chunk's tags are few.
    """
    kept = ["chunk_id", "chunk_type", "memory_category", "timestamp", "source_document"]
    rows = chunks.where(F.size("tags") > 1).withColumnRenamed("id", "chunk_id")
    first = rows.select("tags", *kept, F.posexplode("tags").alias("i", "a"))
    pairs = first.select("a", *kept, F.explode(F.slice("tags", F.col("i") + 2, F.size("tags"))).alias("b")).where("a <> b")
    both = pairs.select(F.stack(F.lit(2), F.col("a"), F.col("b"), F.col("b"), F.col("a")).alias("src", "dst"), *kept)
    return both.select("src", "dst", *kept, weight(F.col("chunk_type")).alias("weight"))


def neighbours(state: GraphState, entity_id: str) -> DataFrame:
    """Outgoing edges of an entity, with ``neighbor_id``."""
    return state.edges.where(F.col("src") == entity_id).withColumn("neighbor_id", F.col("dst"))


def neighbour_counts(state: GraphState, entity_id: str) -> DataFrame:
    """(id, canonical_name, entity_type, count, latest) of an entity's neighbours."""
    found = state.edges.where(F.col("src") == entity_id).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("latest"))
    return found.join(state.entities.select("id", "canonical_name", "entity_type"), "id")


def chunks_of_entities(state: GraphState, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Chunks tagged with any of a few given ids, or with any id of column ``id`` of a table."""
    if isinstance(ids, DataFrame):
        hit = state.chunks.select(F.col("id").alias("chunk"), F.explode("tags").alias("tag")).join(ids.select(F.col("id").alias("tag")), "tag", "left_semi").select("chunk").distinct()
        return state.chunks.join(hit, state.chunks["id"] == hit["chunk"], "left_semi")
    return state.chunks.where(F.arrays_overlap("tags", F.array(*map(F.lit, ids))))


def evidence(state: GraphState, a: str, b: str, limit: int = 15) -> DataFrame:
    """Chunks tagged with both, newest first."""
    return newest(state.chunks.where(F.array_contains("tags", a) & F.array_contains("tags", b)), limit)


def newest(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.orderBy(F.coalesce("timestamp", F.lit(0)).desc(), "id").limit(limit)


def temporal_chain(state: GraphState, entity_id: str) -> DataFrame:
    """The entity's chunks with ``at``, oldest first by timestamp or else creation.

    Chunks it lists come from ``mentions``; one that lists none falls back to the chunks tagged with it.
    """
    listed = state.mentions.where(F.col("entity_id") == entity_id)
    own = state.chunks.join(listed.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    any_listed = listed.agg(F.count(F.lit(1)).alias("n"))
    tagged = state.chunks.where(F.array_contains("tags", entity_id)).join(any_listed.where("n = 0"))
    return own.unionByName(tagged.drop("n")).withColumn("at", F.coalesce("timestamp", "created_at")).orderBy("at", "id")


def induced(state: GraphState, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends in column ``id`` of ``members``, and chunks tagged with any of it."""
    m = members.select("id").distinct()
    edges = state.edges.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.select(*state.edges.columns), chunks_of_entities(state, m)


def export_subgraph(state: GraphState, ids: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, chunks) around given ids; unknown ones are ignored."""
    known = state.entities.where(F.col("id").isin(*ids))
    return known, *induced(state, known)


def orphans(state: GraphState) -> DataFrame:
    """Entities without an edge."""
    ends = state.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return state.entities.join(ends, "id", "left_anti")


def unordered_pair() -> list[Column]:
    return [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]


def relationship_briefs(state: GraphState, members: DataFrame) -> DataFrame:
    """(a, b, count, latest): directed edges between members by unordered pair."""
    edges, _ = induced(state, members)
    return edges.groupBy(*unordered_pair()).agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("latest"))


def pending_items(state: GraphState, members: DataFrame, types: Sequence[str] = ("Decision", "ActionItem")) -> DataFrame:
    """Chunks of open types that members mention, newest first."""
    hit = state.mentions.join(members.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("chunk_id").alias("id")).distinct()
    return state.chunks.where(F.col("chunk_type").isin(*types)).join(hit, "id", "left_semi").orderBy(F.coalesce("timestamp", F.lit(0)).desc(), "id")


def tag_names(state: GraphState, chunks: DataFrame) -> DataFrame:
    """(id, names): names of each chunk's tags in their order, unknown ones left out."""
    each = chunks.select("id", F.posexplode("tags").alias("pos", "tag"))
    named = each.join(state.entities.select(F.col("id").alias("tag"), "canonical_name"), "tag")
    return named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical_name"))), lambda x: x["canonical_name"]).alias("names"))


def unchanged_documents(incoming: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows (document, sha256, ...) whose stored hash is the same."""
    return incoming.join(hashes, ["document", "sha256"], "left_semi")


def changed_documents(incoming: DataFrame, hashes: DataFrame) -> DataFrame:
    return incoming.join(hashes, ["document", "sha256"], "left_anti")


def prefix_search(state: GraphState, prefix: str) -> DataFrame:
    return state.chunks.where(F.col("source_document").startswith(prefix))


def edge_between(state: GraphState, pairs: DataFrame) -> DataFrame:
    """Rows (name_a, name_b) with ``found``: whether an edge links entities of these names, without regard to case."""
    names = state.entities.select("id", F.lower("canonical_name").alias("name"))
    ids = pairs.select("name_a", "name_b", F.lower("name_a").alias("la"), F.lower("name_b").alias("lb"))
    ids = ids.join(names.select(F.col("id").alias("src"), F.col("name").alias("la")), "la", "left").join(names.select(F.col("id").alias("dst"), F.col("name").alias("lb")), "lb", "left")
    ids, edges = materialise(ids), state.edges.select("src", "dst")
    for c in ("src", "dst"):  # where an end's ids are few, most edges drop out unshuffled
        edges = edges.join(narrow(materialise(ids.select(c).distinct())), c, "left_semi")
    linked = ids.join(edges.select("src", "dst").distinct().withColumn("hit", F.lit(True)), ["src", "dst"], "left")
    return linked.groupBy("name_a", "name_b").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("found"))
