"""From documents to the graph: parse, classify, tag, link, write."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweave.functions import content_hash, cosine, stable_id
from mnemoweave.operators.lookups import name_index, valid_mention
from mnemoweave.plans import mutations
from mnemoweave.plans.embedding import embedded
from mnemoweave.plans.labelling import Client, RuleClient, classified, tagged  # noqa: F401
from mnemoweave.plans.parsing import parsed
from mnemoweave.plans.patterns import occurrences
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise

AUTO_LINK, REVIEW = 0.85, 0.70

#: Labels of chunks and entities, and what they are stored as.
CHUNK_LABELS = {
    "decision": "Decision", "discussion": "Discussion", "action_item": "ActionItem", "status_update": "StatusUpdate", "preference": "Preference",
    "background": "Background", "debugging": "Discussion", "code_review": "Discussion", "architecture": "Decision", "learning": "Background",
}
ENTITY_LABELS = ("person", "project", "technology", "organization", "location", "decision", "concept", "preference", "goal", "pattern", "skill")

def stored_type(label: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in CHUNK_LABELS.items() for x in kv))
    return F.coalesce(pairs[F.lower(label)], F.lit("Discussion"))


class Linked(NamedTuple):
    tagged: DataFrame  # chunk_id, pos, name, entity_type, existing_id
    review: DataFrame  # name, entity_id, similarity, chunk_text, source_document


def _near_names(state: GraphState, names: DataFrame) -> DataFrame:
    """(key, entity_id, known) of names (key) and the entities whose lower-cased name contains them."""
    known = materialise(name_index(state).where("kind = 'name'").select(F.col("name").alias("known"), F.col("id").alias("entity_id")))
    distinct = known.select(F.col("known").alias("text_id"), F.col("known").alias("text")).distinct()
    hits = materialise(occurrences(distinct, names.select(F.col("key").alias("name"))))
    return hits.select(F.col("name").alias("key"), F.col("text_id").alias("known")).join(known, "known")


def linked(state: GraphState, rows: DataFrame, vectors: DataFrame | None = None, name_vectors: DataFrame | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Linked:
    """Valid mentions with the entity they mean: an exact name or alias, else the best of similar names by cosine.

    Similar names are compared if vectors are given, of entities (entity_id, vector) and of lower-cased names (key,
    vector), or ``embed``, which then makes one vector for each distinct name on either side.
    """
    each = rows.select(F.col("id").alias("chunk_id"), "source_document", "text", F.posexplode("tags").alias("pos", "t")).select("chunk_id", "source_document", "text", "pos", F.trim("t.name").alias("name"), F.lower("t.entity_type").alias("entity_type"))
    each = each.where(valid_mention(F.col("name"), F.col("entity_type"), F.col("text"), list(ENTITY_LABELS))).withColumn("entity_type", F.initcap("entity_type"))
    exact = name_index(state).groupBy(F.col("name").alias("key")).agg(F.min_by("id", F.struct(F.when(F.col("kind") == "name", 0).otherwise(1).alias("p"), "id")).alias("exact_id"))
    met = each.withColumn("key", F.lower("name")).join(exact, "key", "left")
    if embed is None and (vectors is None or name_vectors is None):
        empty = met.where(F.lit(False)).select("name", F.lit("").alias("entity_id"), F.lit(0.0).alias("similarity"), F.col("text").alias("chunk_text"), "source_document")
        return Linked(met.select("chunk_id", "pos", "name", "entity_type", F.col("exact_id").alias("existing_id")), empty)
    met = materialise(met)
    near = _near_names(state, met.where("exact_id is null").select("key").distinct())
    if embed is not None:
        near = materialise(near)
        names = near.select("key").unionByName(near.select(F.col("known").alias("key"))).distinct()
        name_vectors = materialise(embedded(names, "key", embed))
        vectors = near.select("entity_id", "known").distinct().join(name_vectors.withColumnRenamed("key", "known"), "known").select("entity_id", "vector")
    scored = near.join(name_vectors.select("key", F.col("vector").alias("v")), "key").join(vectors, "entity_id").withColumn("similarity", cosine(F.col("v"), F.col("vector")))
    # equal cosines differ in their last digits with the order of summing, so that ties are told by twelve
    best = scored.groupBy("key").agg(F.max(F.struct(F.round("similarity", 12).alias("s"), "entity_id", "similarity")).alias("best")).select("key", "best.entity_id", "best.similarity")
    out = met.join(best, "key", "left")
    link = F.coalesce("exact_id", F.when(F.col("similarity") >= AUTO_LINK, F.col("entity_id")))
    review = out.where(F.col("exact_id").isNull() & (F.col("similarity") >= REVIEW) & (F.col("similarity") < AUTO_LINK))
    return Linked(out.select("chunk_id", "pos", "name", "entity_type", link.alias("existing_id")), review.select("name", "entity_id", "similarity", F.substring("text", 1, 200).alias("chunk_text"), "source_document"))


class Ingested(NamedTuple):
    state: GraphState
    results: DataFrame  # source_document, status, chunks, failed_chunks, error
    review: DataFrame


def ingest(
    state: GraphState, docs: DataFrame, now: int, client: Client | None = None, replace: bool = False, raw: DataFrame | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None, whole: bool = False,
) -> Ingested:
    """Documents (source_document, text, memory_category) into the graph; those whose hash is stored are left alone.

    ``replace`` first removes what a changed document wrote before; else its content accumulates.  ``whole`` takes
    documents whose hash is stored too, as reingestion does.  ``raw`` gives chunks parsed by another way, such as
    sessions.  With ``embed``, mentions that no name fits are compared with similar names: they are linked, or wait in
    ``review``.

    A document without a text could not be read: its status is failed, and no hash is stored.  One whose chunks were not
    all tagged is partial, and only tagged chunks are written; others, blank ones too, are complete.
    """
    unread = docs.where("text is null").select("source_document", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("failed_chunks"), F.lit("the text could not be read").alias("error"))
    docs = docs.where("text is not null")
    incoming = docs.select(F.col("source_document").alias("document"), content_hash(F.col("text")).alias("sha256"))
    changed = materialise(incoming if whole else mutations.split_by_change(incoming, state)[0])
    named = changed.select(F.col("document").alias("source_document"))
    todo = docs.join(named, "source_document", "left_semi")
    if replace:
        state = mutations.remove_documents(state, changed.select("document")).state
    pieces = parsed(todo) if raw is None else raw.join(named, "source_document", "left_semi")
    pieces = pieces.withColumn("id", stable_id(F.col("source_document"), F.col("position"), F.col("text"), F.lit(now)))
    chunks = materialise(classified(pieces, client))
    tags = materialise(tagged(chunks, client))
    done = tags.where("not failed")
    found = linked(state, done, embed=embed)
    rows = chunks.join(done.select("id"), "id", "left_semi").select("id", "source_document", "section_name", "speaker", "timestamp", stored_type(F.col("label")).alias("chunk_type"), "memory_category", "text", F.lit(now).cast("long").alias("created_at"), F.array().cast("array<string>").alias("projects"))
    state = mutations.write_tagged(state, rows, found.tagged, lambda name: stable_id(F.lit("entity"), name), now)
    state = mutations.store_hashes(state, changed)
    per = chunks.groupBy("source_document").agg(F.count(F.lit(1)).alias("chunks")).join(done.groupBy("source_document").agg(F.count(F.lit(1)).alias("done")), "source_document", "left")
    results = todo.select("source_document").join(per, "source_document", "left").na.fill(0, ["chunks", "done"]).withColumn("failed_chunks", F.col("chunks") - F.col("done"))
    status = F.when(F.col("failed_chunks") > 0, "partial").otherwise("complete")
    results = results.select("source_document", status.alias("status"), "chunks", "failed_chunks", F.lit(None).cast("string").alias("error"))
    return Ingested(state, results.unionByName(unread), found.review)


def rolled_up(results: DataFrame) -> DataFrame:
    """(documents, complete, partial, failed, chunks) of results."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count(F.lit(1)).alias("documents"), n("complete"), n("partial"), n("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def ask(state: GraphState, call: Callable[[list[str]], list[str]], prompts: DataFrame) -> DataFrame:
    """``prompts`` (id, prompt) with ``answer``, in Arrow batches."""
    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(call(p.tolist()), dtype="object")

    return prompts.withColumn("answer", run("prompt"))
