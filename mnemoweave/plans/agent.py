"""Context for an agent without a language model: mentions, candidates, briefs, profile."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import path_stem
from mnemoweave.operators.aggregates import last_seen, top_by_group, top_neighbours
from mnemoweave.operators.relations import neighbour_counts, pending_items, relationship_briefs, temporal_chain
from mnemoweave.plans.patterns import SLICE_CHARS, occurrences
from mnemoweave.plans.retrieval import recent_events, similarities
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise

NAME_BONUS = 0.3
SHORTEST_NAME = 3
PIECE_ENTITIES, PIECE_TEXTS = 2048, 2048  # of a name's entities in one task, and of the texts with the name, all against all
BRIEF_ENTITIES, FULL_ENTITIES = 8, 20
PROFILE_TYPES = ("Preference", "Goal", "Pattern", "Skill", "Project")


def mentions_in(state: GraphState, texts: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(text_id, id, match) of entities named in (text_id, text): 1.0 as a word, 0.7 within one, 0.6 by an alias.

    Names of under three characters are not searched.  Entities of one name and at most one alias are paired with texts
    without an exchange of pairs: a text found by an alias carries the few entities that it names themselves, which are
    left out.  Pairs of other entities are made distinct.
    """
    long = lambda names: F.filter(names, lambda n: F.length(n) >= SHORTEST_NAME)
    known = state.entities.groupBy("id").agg(F.collect_set(F.lower("canonical_name")).alias("owns"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))
    known = known.select("id", long(F.col("owns")).alias("owns"), F.coalesce(long(F.array_distinct(F.transform("aliases", F.lower))), F.array().cast("array<string>")).alias("aliases"))
    known = known.select("id", "owns", F.array_except("aliases", "owns").alias("aliases"))
    plain = (F.size("owns") <= 1) & (F.size("aliases") <= 1)
    each = lambda names, own: known.select("id", F.explode(names).alias("name"), F.lit(own).alias("own"), plain.alias("plain"))
    each = materialise(each("owns", True).unionByName(each("aliases", False)))
    hits = occurrences(texts.select("text_id", F.lower("text").alias("text")), each, slice_chars)
    hits = materialise(hits.groupBy("text_id", "name").agg(F.max("word").alias("word")))
    named = _met(hits, each.where("plain and own")).select("text_id", "id", F.when(F.col("word"), 1.0).otherwise(0.7).alias("match"))
    aliases = each.where("plain and not own")
    told = named.select("text_id", F.col("id").alias("told")).join(aliases.select(F.col("id").alias("told"), "name"), "told")
    by_alias = _met(hits.select("text_id", "name"), aliases, told)
    by_alias = by_alias.where(F.col("told").isNull() | ~F.array_contains("told", F.col("id"))).select("text_id", "id", F.lit(0.6).alias("match"))
    match = F.when(~F.col("own"), 0.6).when(F.col("word"), 1.0).otherwise(0.7)
    rest = hits.join(each.where("not plain"), "name").groupBy("text_id", "id").agg(F.max(match).alias("match"))
    return named.unionByName(by_alias).unionByName(rest)


def _met(hits: DataFrame, each: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """``hits`` by name with the entities (id, name).  A name of many entities and texts is cut into pieces of both, each of which meets each.

    ``told``, rows (text_id, told, name), becomes an array beside each text: those of it in the piece that the text meets, null if none are.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, size, c: df.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(c))
    sizes = materialise(count(each, PIECE_ENTITIES, "pieces").join(count(hits, PIECE_TEXTS, "cuts"), "name"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = each.select("id", "name").join(sizes, "name").select("id", "name", dealt("id", "pieces").alias("piece"), every("cuts").alias("cut"))
    spread = hits.join(sizes, "name").withColumns({"cut": dealt("text_id", "cuts"), "piece": every("pieces")}).drop("pieces", "cuts")
    key = ["name", "piece", "cut"]
    if told is not None:
        known = told.join(sizes, "name").groupBy(F.col("text_id").alias("t"), F.col("name").alias("k"), dealt("told", "pieces").alias("at")).agg(F.collect_set("told").alias("told"))
        spread = spread.join(known, F.col("text_id").eqNullSafe(F.col("t")) & (F.col("name") == F.col("k")) & (F.col("piece") == F.col("at")), "left").select(*hits.columns, "told", "piece", "cut")
    return spread.repartition(parts, *key).join(mine.repartition(parts, *key), key)


def candidates(named: DataFrame, similar: DataFrame, limit: int) -> DataFrame:
    """(id, score): similarity (0 for name hits only) and a bonus for the match of a name."""
    both = named.join(similar, "id", "full_outer")
    score = F.coalesce("similarity", F.lit(0.0)) + NAME_BONUS * F.coalesce("match", F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def briefs(state: GraphState, members: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, canonical_name, entity_type, importance, last_seen, mentions, near): what is told about each member."""
    top = ranks.agg(F.max("rank").alias("top"))
    names = state.entities.select(F.col("id").alias("neighbor"), F.col("canonical_name").alias("near_name"))
    near = top_neighbours(state, 3).join(members.select("id"), "id", "left_semi").join(names, "neighbor")
    near = near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "near_name"))), lambda s: s["near_name"]), ", ").alias("near"))
    count = state.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    e = state.entities.select("id", "canonical_name", "entity_type").join(members.select("id"), "id", "left_semi")
    e = e.join(ranks, "id", "left").join(top).join(last_seen(state), "id", "left").join(count, "id", "left").join(near, "id", "left")
    importance = F.when(F.col("top") > 0, F.coalesce("rank", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return e.select("id", "canonical_name", "entity_type", importance.alias("importance"), "last_seen", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("near", F.lit("")).alias("near"))


def profile(state: GraphState, ranks: DataFrame, each: int = 10, least_mentions: int = 3) -> DataFrame:
    """(bucket, id, canonical_name, place): a user's preferences, goals, patterns, skills, projects and frequent concepts."""
    count = state.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    e = state.entities.drop("rank").join(ranks, "id").join(count, "id", "left")
    often = (F.col("entity_type") == "Concept") & (F.coalesce("n", F.lit(0)) >= least_mentions)
    e = e.where(F.col("entity_type").isin(*PROFILE_TYPES) | often).withColumnRenamed("entity_type", "bucket")
    return top_by_group(e, ["bucket"], [F.desc("rank"), F.col("id")], each).select("bucket", "id", "canonical_name", "place")


class Context(NamedTuple):
    """What an agent is told: who is concerned, what connects them, what is open, and in a full context what happened."""

    entities: DataFrame  # briefs, with their score
    relationships: DataFrame  # a, b, count, latest
    pending: DataFrame  # chunk columns
    events: DataFrame  # chunk columns; none in a brief context


def context(state: GraphState, vectors: DataFrame, ranks: DataFrame, situation: str, query: list[float], full: bool = False, entities: int | None = None, events: int = 15, since: int | None = None, until: int | None = None) -> Context:
    """The context of a situation (a text and its vector): entities it names or is similar to, the best ``entities`` of them.

    ``since`` and ``until`` bound the edges that lead to events.
    """
    k = entities or (FULL_ENTITIES if full else BRIEF_ENTITIES)
    named = mentions_in(state, state.entities.sparkSession.createDataFrame([("", situation)], "text_id string, text string")).select("id", "match")
    pool = similarities(vectors, query).orderBy(F.desc("similarity"), "id").limit(3 * k)
    members = materialise(candidates(named, pool, k))
    shown = recent_events(state, members, 2, events, since, until) if full else state.chunks.limit(0)
    return Context(briefs(state, members, ranks).join(members, "id"), relationship_briefs(state, members), pending_items(state, members), shown)


def entity_profile(state: GraphState, entity_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the entity, its ten most frequent neighbours, its first five chunks)."""
    near = neighbour_counts(state, entity_id).orderBy(F.desc("count"), "id").limit(10)
    return state.entities.where(F.col("id") == entity_id), near, temporal_chain(state, entity_id).limit(5)


def mentions(state: GraphState, entity_id: str, limit: int = 20) -> DataFrame:
    """The newest chunks of an entity, newest first."""
    return temporal_chain(state, entity_id).orderBy(F.desc("at"), F.desc("id")).limit(limit)


def timeline(state: GraphState, entity_id: str, limit: int = 30) -> DataFrame:
    """The newest chunks of an entity, oldest first."""
    return mentions(state, entity_id, limit).orderBy("at", "id")


def summary_line(state: GraphState, entity_id: str) -> DataFrame:
    """(line): ``name (type): three neighbours, n chunks``."""
    near = neighbour_counts(state, entity_id).orderBy(F.desc("count"), "id").limit(3)
    w = Window.orderBy(F.desc("count"), F.col("id"))
    near = near.withColumn("k", F.row_number().over(w)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "canonical_name"))), lambda s: s["canonical_name"]), ", ").alias("near"))
    count = state.mentions.where(F.col("entity_id") == entity_id).agg(F.count(F.lit(1)).alias("n"))
    e = state.entities.where(F.col("id") == entity_id).join(near).join(count)
    return e.select(F.concat("canonical_name", F.lit(" ("), "entity_type", F.lit("): "), "near", F.lit(", "), F.col("n").cast("string"), F.lit(" chunks")).alias("line"))


def injection_text(found: Context) -> str:
    """Sectioned text of an agent context: its entities by score with importance and mentions, relations, open items, recent events.

    All rows of the context are told; how many there are is the context's own limits.
    """
    day = lambda r: str(r["day"] or "undated")
    dated = lambda df: df.withColumn("day", F.date_format(F.timestamp_seconds(F.coalesce("timestamp", "created_at")), "yyyy-MM-dd"))
    score = [F.desc("score")] if "score" in found.entities.columns else []
    newest_first = [F.desc_nulls_last(F.coalesce("timestamp", "created_at")), F.col("id")]
    sections = [
        ("Entities", [f"- {r['canonical_name']} ({r['entity_type']}, importance {r['importance']:.2f}, {r['mentions']} mentions): {r['near']}" for r in found.entities.orderBy(*score, "id").collect()]),
        ("Relationships", [f"- {r['a']} / {r['b']}: {r['count']}" for r in found.relationships.orderBy(F.desc("count"), "a", "b").collect()]),
        ("Pending", [f"- {day(r)} [{r['chunk_type']}] {r['text']}" for r in dated(found.pending).orderBy(*newest_first).collect()]),
        ("Recent Events", [f"- {day(r)} [{r['chunk_type']}] {r['text']}" for r in dated(found.events).orderBy(*newest_first).collect()]),
    ]
    return "\n\n".join(f"## {t}\n" + "\n".join(lines) for t, lines in sections if lines)


def split_memories(chunks: DataFrame, each: int = 2) -> DataFrame:
    """Chunks with ``memory``: episodic for episodic and conversation sources, core for others, the newest of each."""
    source = F.col("source_document")
    kind = F.when(F.contains(source, F.lit("episodic")) | F.contains(source, F.lit("conversation")), "episodic").otherwise("core")
    return top_by_group(chunks.withColumn("memory", kind), ["memory"], [F.coalesce("timestamp", F.lit(0)).desc(), F.col("id")], each)


def stems_of(state: GraphState, entity_id: str) -> DataFrame:
    return state.entity_documents.where(F.col("entity_id") == entity_id).select(path_stem(F.col("document")).alias("stem")).distinct()
