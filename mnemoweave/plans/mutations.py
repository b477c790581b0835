"""Mutations: pure functions from one state to the next."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.functions import decayed, edge_weight
from mnemoweave.operators import aggregates
from mnemoweave.operators.lookups import upsert_hashes, without_hashes
from mnemoweave.operators.relations import cooccurrences, orphans, unchanged_documents
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise, narrow


def add_entities(state: GraphState, rows: DataFrame) -> GraphState:
    """With the rows whose id is new; columns they lack are null."""
    new = rows.join(state.entities.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return state._replace(entities=state.entities.unionByName(new, allowMissingColumns=True).select(*state.entities.columns))


def add_cooccurrences(state: GraphState, rows: DataFrame) -> GraphState:
    """With both directions of rows (a, b, chunk_id, chunk_type, ...) whose ends differ and exist; others are left out."""
    known = state.entities.select("id")
    ok = rows.where("a <> b").join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    one = lambda s, d: ok.withColumnsRenamed({s: "src", d: "dst"}).withColumn("weight", edge_weight(F.col("chunk_type")))
    both = one("a", "b").unionByName(one("b", "a"))
    return state._replace(edges=state.edges.unionByName(both, allowMissingColumns=True).select(*state.edges.columns))


def store_chunks(state: GraphState, rows: DataFrame) -> GraphState:
    """With chunks added, or replaced by id; known entities list the chunks they are tagged in once."""
    rows = rows.dropDuplicates(["id"])
    chunks = state.chunks.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True).select(*state.chunks.columns)
    tagged = rows.select(F.explode("tags").alias("entity_id"), F.col("id").alias("chunk_id")).distinct()
    tagged = tagged.join(state.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    new = tagged.join(state.mentions, ["entity_id", "chunk_id"], "left_anti")
    return state._replace(chunks=chunks, mentions=state.mentions.unionByName(new))


def merge_entities(state: GraphState, pairs: DataFrame, now: int) -> GraphState:
    """With each ``merge_id`` of (keep_id, merge_id, confidence, method) absorbed by its ``keep_id``.

    Names, aliases, chunks and documents are united, access counts added, edges redirected without self-loops, and the
    first occurrence of a merged tag in a chunk replaced.  A merge_id stands once and is no keep_id of another row.
    """
    known = state.entities.select("id")
    pairs = pairs.where("keep_id <> merge_id").join(known.withColumnRenamed("id", "keep_id"), "keep_id", "left_semi").join(known.withColumnRenamed("id", "merge_id"), "merge_id", "left_semi")
    gone = pairs.select(F.col("merge_id").alias("id"), "keep_id")
    absorbed = state.entities.join(pairs.withColumnRenamed("merge_id", "id"), "id").groupBy("keep_id").agg(
        F.flatten(F.collect_list(F.concat(F.array("canonical_name"), "aliases"))).alias("more"),
        F.sum("access_count").alias("count"),
        F.collect_list(F.struct(F.col("id").alias("merged_entity_id"), F.col("canonical_name").alias("merged_entity_name"), F.coalesce("method", F.lit("direct")).alias("method"), F.lit(now).cast("long").alias("merged_at"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("records"),
    )
    kept = state.entities.join(gone.select("id"), "id", "left_anti").join(absorbed.withColumnRenamed("keep_id", "id"), "id", "left")
    changed = F.col("more").isNotNull()
    aliases = F.filter(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))), lambda a: a != F.col("canonical_name"))
    entities = kept.withColumns({
        "aliases": F.when(changed, aliases).otherwise(F.col("aliases")),
        "access_count": F.col("access_count") + F.coalesce("count", F.lit(0)),
        "updated_at": F.when(changed, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
        "merge_history": F.when(changed, F.concat("merge_history", "records")).otherwise(F.col("merge_history")),
    }).select(*state.entities.columns)

    def moved(df: DataFrame, column: str) -> DataFrame:
        m = gone.select(F.col("id").alias(column), F.col("keep_id").alias("_keep"))
        return df.join(m, column, "left").withColumn(column, F.coalesce("_keep", column)).drop("_keep")

    edges = moved(moved(state.edges, "src"), "dst").where("src <> dst").select(*state.edges.columns)
    each = state.chunks.select("id", F.posexplode("tags").alias("pos", "tag")).join(gone.withColumnsRenamed({"id": "tag", "keep_id": "new"}), "tag")
    first = each.groupBy("id", "tag", "new").agg(F.min("pos").alias("pos"))
    swaps = first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("swaps"))
    tags = F.when(F.col("swaps").isNotNull(), F.transform("tags", lambda t, i: F.coalesce(F.col("swaps")[i], t))).otherwise(F.col("tags"))
    chunks = state.chunks.join(swaps, "id", "left").withColumn("tags", tags).select(*state.chunks.columns)
    return state._replace(
        entities=entities, edges=edges, chunks=chunks,
        mentions=moved(state.mentions, "entity_id").select("entity_id", "chunk_id").distinct(),
        entity_documents=moved(state.entity_documents, "entity_id").select("entity_id", "document").distinct(),
    )


def remove_entities(state: GraphState, ids: DataFrame) -> GraphState:
    """Without the entities of column ``id`` and their edges; chunks keep their tags."""
    ids = ids.select("id").distinct()
    by = lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
    return state._replace(
        entities=by(state.entities, "id"), edges=by(by(state.edges, "src"), "dst"), mentions=by(state.mentions, "entity_id"), entity_documents=by(state.entity_documents, "entity_id")
    )


class Removal(NamedTuple):
    state: GraphState
    counts: DataFrame  # chunks_removed, edges_removed, entities_removed, entities_updated


def remove_documents(state: GraphState, documents: DataFrame, lazy: bool = False) -> Removal:
    """Without the chunks of documents (document), the edges of those chunks, and what is left of their entities.

    Entities that list a document lose it and the removed chunks; those with no document, chunk and edge left go.
    ``lazy`` stores nothing but the documents: for callers that read one table of the new state and not the others.
    """
    held = (lambda df: df) if lazy else lambda df: narrow(materialise(df))
    documents = narrow(materialise(documents.select("document").distinct()))
    of = documents.withColumnRenamed("document", "source_document")
    dead = held(state.chunks.join(of, "source_document", "left_semi").select(F.col("id").alias("chunk_id")))
    chunks = state.chunks.join(of, "source_document", "left_anti").select(*state.chunks.columns)
    edges = state.edges.join(dead, "chunk_id", "left_anti").select(*state.edges.columns)
    gone_edges = state.edges.join(dead, "chunk_id", "left_semi")
    listing = held(state.entity_documents.join(documents, "document", "left_semi").select("entity_id").distinct())
    left_documents = state.entity_documents.join(documents, "document", "left_anti").select("entity_id", "document")
    trimmed = held(state.mentions.join(dead, "chunk_id", "left_semi").join(listing, "entity_id", "left_semi").select("entity_id", "chunk_id"))
    mentions = state.mentions.join(trimmed, ["entity_id", "chunk_id"], "left_anti")
    met = [left_documents.select("entity_id"), mentions.select("entity_id"), edges.select(F.explode(F.array("src", "dst")).alias("entity_id"))]
    alive = reduce(DataFrame.unionByName, [df.join(listing, "entity_id", "left_semi").distinct() for df in met])  # only of those that list a document
    empty = held(listing.join(alive.distinct(), "entity_id", "left_anti").select(F.col("entity_id").alias("id")))
    entities = state.entities.join(empty, "id", "left_anti").select(*state.entities.columns)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(dead, "chunks_removed").join(count(gone_edges, "edges_removed")).join(count(empty, "entities_removed")).join(count(listing, "entities_updated"))
    counts = counts.withColumn("entities_updated", F.col("entities_updated") - F.col("entities_removed"))
    hashes = without_hashes(state.document_hashes, documents)
    return Removal(state._replace(entities=entities, edges=edges, chunks=chunks, mentions=mentions, entity_documents=left_documents, document_hashes=hashes), counts)


def clear_prefix(state: GraphState, prefix: str, lazy: bool = False) -> Removal:
    return remove_documents(state, state.chunks.where(F.col("source_document").startswith(prefix)).select(F.col("source_document").alias("document")), lazy)


def decay(state: GraphState, now: int, half_life_days: float = 30) -> GraphState:
    """With decayed access counts; ``updated_at`` stays, so repeated runs compound."""
    count = decayed(F.col("access_count"), F.col("updated_at"), now, half_life_days)
    return state._replace(entities=state.entities.withColumn("access_count", F.when(F.col("updated_at") < now, count).otherwise(F.col("access_count"))))


def reweigh(state: GraphState) -> GraphState:
    return state._replace(edges=aggregates.reweighted(state.edges))


def dedup_edges(state: GraphState) -> GraphState:
    return state._replace(edges=aggregates.deduplicated(state.edges))


def prune_edges(state: GraphState, threshold: float = 0.01) -> GraphState:
    return state._replace(edges=aggregates.pruned(state.edges, threshold))


def cleanup_orphans(state: GraphState, now: int, oldest_days: float = 7, grace_days: float = 3) -> GraphState:
    """Without entities that have no edge and are old enough by both their creation and the grace period."""
    age = F.lit(now) - F.col("created_at")
    return remove_entities(state, orphans(state).where((age >= oldest_days * 86400) & (age >= grace_days * 86400)).select("id"))


def write_tagged(state: GraphState, chunks: DataFrame, tagged: DataFrame, new_id, now: int) -> GraphState:
    """With chunks and what was tagged in them: rows (chunk_id, pos, name, entity_type, existing_id).

    A mention without an existing id becomes a new entity, one for each lower-cased name; a linked one adds the chunk but
    not the document to its entity.  Tags keep their positions, so a name twice in a chunk pairs twice with the others.
    """
    named = tagged.withColumn("entity_id", F.coalesce("existing_id", new_id(F.lower("name"))))
    located = named.join(chunks.select(F.col("id").alias("chunk_id"), "source_document"), "chunk_id")
    fresh = located.where("existing_id is null").groupBy(F.col("entity_id").alias("id")).agg(F.min_by("name", F.struct("chunk_id", "pos")).alias("canonical_name"), F.min_by("entity_type", F.struct("chunk_id", "pos")).alias("entity_type"))
    empty = F.array().cast("array<string>")
    fresh = fresh.withColumns({"aliases": empty, "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long"), "access_count": F.lit(0).cast("long"), "rank": F.lit(0.0), "merge_history": F.array().cast(state.entities.schema["merge_history"].dataType), "projects": empty})
    documents = located.where("existing_id is null").select("entity_id", F.col("source_document").alias("document")).distinct()
    state = add_entities(state, fresh)
    state = state._replace(entity_documents=state.entity_documents.unionByName(documents).distinct())
    tags = named.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]).alias("tags"))
    rows = chunks.drop("tags").join(tags.withColumnRenamed("chunk_id", "id"), "id", "left").withColumn("tags", F.coalesce("tags", empty))
    state = store_chunks(state, rows)
    return state._replace(edges=state.edges.unionByName(cooccurrences(rows, edge_weight).select(*state.edges.columns)))


def split_by_change(incoming: DataFrame, state: GraphState) -> tuple[DataFrame, DataFrame]:
    """(changed, unchanged) of (document, sha256, ...) rows."""
    return incoming.join(state.document_hashes, ["document", "sha256"], "left_anti"), unchanged_documents(incoming, state.document_hashes)


def store_hashes(state: GraphState, incoming: DataFrame) -> GraphState:
    return state._replace(document_hashes=upsert_hashes(state.document_hashes, incoming.select("document", "sha256")))
