"""Point lookups, filters and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import basename
from mnemoweave.state import GraphState


def entity(state: GraphState, entity_id: str) -> DataFrame:
    return state.entities.where(F.col("id") == entity_id)


def chunk(state: GraphState, chunk_id: str) -> DataFrame:
    return state.chunks.where(F.col("id") == chunk_id)


def chunks_by_document(state: GraphState, document: str) -> DataFrame:
    return state.chunks.where(F.col("source_document") == document)


def chunks_in_window(state: GraphState, start: int | None = None, end: int | None = None) -> DataFrame:
    """Dated chunks within inclusive bounds, either of which may be open."""
    held = F.col("timestamp").isNotNull()
    if start is not None:
        held &= F.col("timestamp") >= start
    if end is not None:
        held &= F.col("timestamp") <= end
    return state.chunks.where(held)


def entities_by_project(state: GraphState, project: str) -> DataFrame:
    return state.entities.where(F.array_contains("projects", project))


def search_entities(state: GraphState, text: str, limit: int = 20) -> DataFrame:
    """Entities whose name, else an alias, contains the text; name hits first."""
    t = text.lower()
    by_name = F.contains(F.lower("canonical_name"), F.lit(t))
    by_alias = F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(t)))
    found = state.entities.where(by_name | by_alias).withColumn("priority", F.when(by_name, 0).otherwise(1))
    return found.orderBy("priority", "canonical_name", "id").limit(limit)


def name_index(state: GraphState) -> DataFrame:
    """(name, id, kind): lower-cased names and aliases."""
    names = state.entities.select(F.lower("canonical_name").alias("name"), "id", F.lit("name").alias("kind"))
    each = state.entities.select(F.explode("aliases").alias("alias"), "id")
    return names.unionByName(each.select(F.lower("alias").alias("name"), "id", F.lit("alias").alias("kind")))


def lookup_by_name(state: GraphState, name: str) -> DataFrame:
    """(id, kind) of entities of exactly this name, or of this alias where no name fits."""
    found = name_index(state).where(F.col("name") == name.lower())
    best = found.withColumn("r", F.rank().over(Window.partitionBy("name").orderBy(F.col("kind").desc())))
    return best.where("r = 1").select("id", "kind").distinct()


def lookup_by_document(state: GraphState, document: str) -> DataFrame:
    return state.entities.join(state.entity_documents.where(F.col("document") == document).select(F.col("entity_id").alias("id")), "id", "left_semi")


def lookup_by_type(state: GraphState, kind: str) -> DataFrame:
    return state.entities.where(F.col("entity_type") == kind)


def resolve(state: GraphState, reference: str) -> DataFrame:
    """The one entity meant by an id, an exact name among the first five hits, or the first hit."""
    t = reference.lower()
    by_id = entity(state, reference).withColumn("priority", F.lit(-2))
    hits = search_entities(state, reference, 5).withColumn("priority", F.when(F.lower("canonical_name") == t, -1).otherwise(F.col("priority")))
    return by_id.unionByName(hits).orderBy("priority", "canonical_name", "id").limit(1).drop("priority")


def all_entity_ids(state: GraphState) -> DataFrame:
    return state.entities.select("id")


def key_entities(ranked: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Top rows of (id, canonical_name, entity_type, rank)."""
    return (ranked.where(F.col("entity_type") == kind) if kind else ranked).orderBy(F.desc("rank"), "id").limit(limit)


def search_by_source(state: GraphState, document: str, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """(first chunks of a document, entities its chunks are tagged with and how many chunks each)."""
    found = chunks_by_document(state, document)
    tags = found.select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("chunks"))
    named = state.entities.select("id", "canonical_name", "entity_type").join(tags, F.col("id") == F.col("tag")).drop("tag")
    return found.orderBy(F.coalesce("timestamp", "created_at"), "id").limit(shown), named


def upsert_hashes(hashes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Hashes with those of ``incoming`` in place of the stored ones."""
    return hashes.join(incoming, "document", "left_anti").unionByName(incoming.dropDuplicates(["document"]))


def without_hashes(hashes: DataFrame, documents: DataFrame) -> DataFrame:
    return hashes.join(documents, "document", "left_anti")


def watched(path: Column, extensions: list[str], ignored_dirs: list[str], ignored_files: list[str]) -> Column:
    """Whether a path passes the filter: no ignored segment, no ignored name, a wanted extension."""
    lits = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    inside = F.arrays_overlap(F.split(path, "/"), lits(ignored_dirs))
    extension = F.regexp_extract(basename(path), r".\.([^.]+)$", 1)
    return ~inside & ~F.array_contains(lits(ignored_files), basename(path)) & F.array_contains(lits(extensions), extension)


def noise_file(path: Column, content: Column) -> Column:
    """Whether a file tells little: a short ``__init__.py``, a test, a conftest."""
    name = basename(path)
    meaning = F.array_join(F.filter(F.split(content, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#")), "")
    return ((name == "__init__.py") & (F.length(meaning) < 50)) | name.rlike(r"^test_|_test\.[A-Za-z]+$") | (name == "conftest.py") | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("tests"), F.lit("test")))


def keyword_hits(text: Column, keywords: Column) -> Column:
    """How many keywords a text contains, without regard to case."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))


def any_keyword(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def valid_mention(name: Column, kind: Column, text: Column, allowed: list[str]) -> Column:
    """Whether an extracted entity has a name that its chunk contains and an allowed type."""
    return F.coalesce((F.trim(name) != "") & F.contains(F.lower(text), F.lower(F.trim(name))) & F.lower(kind).isin(*allowed), F.lit(False))


def not_filler(chunk_type: Column) -> Column:
    return F.lower(chunk_type) != "filler"
