"""Anchor and expand: from a question's vector to scored chunks and budgeted text.

Only counts and the few kept rows reach the driver; everything before the last text is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import combined_score, cosine, day, distance_weight, path_stem, quoted, score_weight
from mnemoweave.operators.aggregates import hops_of_chunks, statistics
from mnemoweave.operators.relations import chunks_of_entities, prefix_search
from mnemoweave.plans.embedding import embedded
from mnemoweave.plans.traversal import expand, hops_over, in_time
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise, narrow

RESERVED_TOKENS = 1000


@dataclass(frozen=True)
class Parameters:
    tier1: int
    tier2: int
    tier3: int
    anchors: int
    hops: int
    entities: int


def adaptive(entities: int, edges: int, budget: int) -> Parameters:
    """Budgets of 10, 60 and 30 percent; anchors, hops and the cap by the size and density of the graph."""
    tier1, tier2 = int(budget * 0.10), int(budget * 0.60)
    dense = edges / max(entities, 1) >= 3.0
    return Parameters(tier1, tier2, budget - tier1 - tier2, min(max(3, entities // 10), 10), 2 if dense else 3, min(max(10, entities // 3), 40))


def anchors(similar: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(id, score): of 3k rows (id, similarity) the best k by similarity and share of the top rank."""
    pool = similar.orderBy(F.desc("similarity"), "id").limit(3 * k)
    top = ranks.agg(F.max("rank").alias("top"))
    scored = pool.join(ranks.select("id", "rank"), "id", "left").join(top)
    return scored.select("id", combined_score(F.col("similarity"), F.coalesce("rank", F.lit(0.0)), F.coalesce("top", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, similarity) of (entity_id, vector) rows."""
    return vectors.select(F.col("entity_id").alias("id"), cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))).alias("similarity"))


class Neighbourhood(NamedTuple):
    entities: DataFrame  # id, hop, weight
    edges: DataFrame  # src, dst, chunk_id, ...
    chunks: DataFrame  # chunk columns, min_hop, score


def expanded(state: GraphState, start: DataFrame, hops: int, cap: int, since: int | None = None, until: int | None = None) -> Neighbourhood:
    """Around all anchors (id) at once: members for each anchor, edges induced within an anchor's own members, then hops
    over those edges, the heaviest ``cap`` entities, the edges inside them and the chunks of those edges.

    ``since`` and ``until`` bound the edges that lead to members, not what is shown between them.
    """
    first = start.select(F.col("id").alias("anchor"), "id")
    members = materialise(expand(in_time(state.edges, since, until), first, hops, per_anchor=True)).select("anchor", "id")
    ids = narrow(materialise(members.groupBy("id").agg(F.collect_set("anchor").alias("anchors"))))
    end = lambda name: ids.select(F.col("id").alias(name), F.col("anchors").alias(f"_{name}"))
    edges = state.edges.join(end("src"), "src").join(end("dst"), "dst").where(F.arrays_overlap("_src", "_dst"))  # an anchor of both
    edges = materialise(edges.select(*state.edges.columns).dropDuplicates(["src", "dst", "chunk_id"]))
    reached = hops_over(edges, start, hops + 1)
    far = members.select("id").distinct().join(reached, "id", "left").select("id", F.coalesce("hop", F.lit(hops + 1)).alias("hop"))
    kept = materialise(far.withColumn("weight", distance_weight(F.col("hop"))).orderBy(F.desc("weight"), "hop", "id").limit(cap))
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    shown = state.chunks.join(narrow(materialise(inside.select(F.col("chunk_id").alias("id")).distinct())), "id", "left_semi")
    nearest = hops_of_chunks(shown, kept.select("id", "hop"))
    scored = shown.join(nearest, "id").withColumn("score", distance_weight(F.col("min_hop")) * score_weight(F.col("chunk_type")))
    return Neighbourhood(kept, inside, scored)


def _fitting(lines: DataFrame, order: list[Column], budget: int, count=None) -> list:
    """The first rows in order whose tokens stay within the budget in all, read piece by piece until one does not."""
    tokens = count(F.col("line")) if count else (F.length("line") / 4).cast("int")
    kept, used = [], 0
    for r in lines.withColumn("_tokens", tokens).orderBy(*order).toLocalIterator():
        used += r["_tokens"] or 0
        if used > budget:
            break
        kept.append(r)
    return kept


def _budgeted(lines: DataFrame, order: list[Column], budget: int, count=None) -> str:
    """The lines in order up to the budget, joined."""
    return "\n".join(r["line"] for r in _fitting(lines, order, budget, count))


def neighbour_names(n: Neighbourhood, names: DataFrame, k: int) -> DataFrame:
    """(id, near): the k neighbours an entity shares most edges with, by name."""
    both = n.edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(n.edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    counted = both.groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "other"))).where(F.col("k") <= k)
    named = placed.join(names.withColumnRenamed("id", "other"), "other")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "canonical_name"))), lambda s: s["canonical_name"]), ", ").alias("near"))


def knowledge_lines(state: GraphState, n: Neighbourhood) -> DataFrame:
    """Tier 1: (id, weight, line) for each kept entity with its type, neighbours and last date."""
    e = n.entities.join(state.entities.select("id", "canonical_name", "entity_type", "updated_at"), "id")
    near = neighbour_names(n, state.entities.select("id", "canonical_name"), 3)
    line = F.concat(F.lit("- "), "canonical_name", F.lit(" ("), "entity_type", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "near"), F.lit("")), F.lit(" ["), day(F.col("updated_at"), "unknown"), F.lit("]"))
    return e.join(near, "id", "left").select("id", "weight", line.alias("line"))


def evidence_lines(n: Neighbourhood) -> DataFrame:
    """Tier 2: (id, score, tags, line) for each chunk: a header and the quoted text."""
    head = F.concat(F.lit("["), "chunk_type", F.lit("] "), path_stem(F.col("source_document")), F.coalesce(F.concat(F.lit(" > "), "section_name"), F.lit("")), F.lit(" ("), day(F.col("timestamp"), "unknown"), F.lit(")"))
    return n.chunks.select("id", "score", "tags", F.concat(head, F.lit("\n"), quoted(F.col("text")), F.lit("\n")).alias("line"))


def peripheral_lines(state: GraphState, n: Neighbourhood, told: DataFrame) -> DataFrame:
    """Tier 3: (id, weight, line) of kept entities outside ``told`` (id)."""
    rest = n.entities.join(told, "id", "left_anti").join(state.entities.select("id", "canonical_name", "entity_type"), "id")
    near = neighbour_names(n, state.entities.select("id", "canonical_name"), 2)
    line = F.concat(F.lit("- "), "canonical_name", F.lit(" ("), "entity_type", F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "near"), F.lit("")))
    return rest.join(near, "id", "left").select("id", "weight", line.alias("line"))


def assembled(state: GraphState, vectors: DataFrame, ranks: DataFrame, query: list[float], query_tokens: int, budget: int, count=None, since: int | None = None, until: int | None = None) -> str:
    """The text of the three tiers for a question; empty where the budget or the graph leaves nothing."""
    room = budget - query_tokens - RESERVED_TOKENS
    counts = statistics(state).first()
    if room <= 0 or not counts["entity_count"]:
        return ""
    p = adaptive(counts["entity_count"], counts["edge_count"], room)
    start = materialise(anchors(similarities(vectors, query), ranks, p.anchors))
    n = expanded(state, start, p.hops, p.entities, since, until)
    tier1 = _budgeted(knowledge_lines(state, n), [F.desc("weight"), F.col("id")], p.tier1, count)
    evidence = evidence_lines(n)
    shown = _fitting(evidence, [F.desc("score"), F.col("id")], p.tier2, count)
    tier2 = "\n".join(r["line"] for r in shown)
    told = state.chunks.sparkSession.createDataFrame([(t,) for t in {t for r in shown for t in r["tags"] or []}], "id string")
    tier3 = _budgeted(peripheral_lines(state, n, told), [F.desc("weight"), F.col("id")], p.tier3, count)
    parts = [("## Knowledge map", tier1), ("## Evidence", tier2), ("## Related", tier3)]
    return "\n\n".join(f"{title}\n{text}" for title, text in parts if text)


def knowledge_map(state: GraphState, ranks: DataFrame, top: int = 30, names: int = 5) -> DataFrame:
    """(entity_type, id, canonical_name, rank, near): the top entities with the sorted names of some neighbours."""
    best = state.entities.drop("rank").join(ranks, "id").orderBy(F.desc("rank"), "id").limit(top)
    pairs = state.edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).join(best.select("id"), "id", "left_semi").distinct()
    named = pairs.join(state.entities.select(F.col("id").alias("other"), "canonical_name"), "other")
    placed = named.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("canonical_name"))).where(F.col("k") <= names)
    near = placed.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("canonical_name")), ", ").alias("near"))
    return best.select("entity_type", "id", "canonical_name", "rank").join(near, "id", "left").orderBy("entity_type", F.desc("rank"), "id")


def semantic_search(state: GraphState, vectors: DataFrame, ranks: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, canonical_name, entity_type, score): anchors with their names."""
    return anchors(similarities(vectors, query), ranks, k).join(state.entities.select("id", "canonical_name", "entity_type"), "id").orderBy(F.desc("score"), "id")


def recent_events(state: GraphState, members: DataFrame, hops: int = 2, limit: int = 15, since: int | None = None, until: int | None = None) -> DataFrame:
    """Chunks around members within ``hops`` over edges in time, newest first."""
    near = expand(in_time(state.edges, since, until), members.select(F.lit(None).cast("string").alias("anchor"), "id"), hops).select("id")
    return chunks_of_entities(state, near).orderBy(F.coalesce("timestamp", F.lit(0)).desc(), "id").limit(limit)


def search_under(state: GraphState, prefix: str, query: list[float], embed: Callable[[list[str]], list[list[float]]], k: int = 5) -> DataFrame:
    """(id, source_document, text, similarity): the k chunks most similar to a vector of those whose source begins with ``prefix``."""
    rows = embedded(prefix_search(state, prefix).select("id", "source_document", "text"), "text", embed)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select("id", "source_document", "text", cosine(F.col("vector"), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)
