"""Counts and sums over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import session_project, type_label
from mnemoweave.operators.relations import unordered_pair
from mnemoweave.state import GraphState


def statistics(state: GraphState) -> DataFrame:
    """One row: entity, edge, chunk and document counts; a document counts if it has an entity."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    documents = count(state.entity_documents.select("document").distinct(), "document_count")
    return count(state.entities, "entity_count").join(count(state.edges, "edge_count")).join(count(state.chunks, "chunk_count")).join(documents)


def entities_by_type(state: GraphState) -> DataFrame:
    return state.entities.groupBy(type_label(F.col("entity_type")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def out_weight(edges: DataFrame) -> DataFrame:
    """(src, weight): the sum over each node's outgoing edges."""
    return edges.groupBy("src").agg(F.sum("weight").alias("weight"))


def reweighted(edges: DataFrame) -> DataFrame:
    """Every edge with its pair's count as weight; edges without an end have none and drop out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("src", "dst"))
    return edges.where("src is not null and dst is not null").withColumn("weight", n.cast("double")).select(*edges.columns)


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the heaviest, then the smallest chunk_id, with the sum of weights.

    Both directions of a pair are one row on the way, and what is not asked for is not carried.  Edges without an end drop out.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst", "weight", "chunk_id")]
    first, there = F.struct((-F.col("weight")).alias("_w"), "chunk_id"), F.col("src") <= F.col("dst")
    made = {"n": (F.count_if, F.lit(True)), "best": (F.min, first), "like": (F.min, F.struct(first.alias("_first"), *rest)), "sum": (F.sum, F.col("weight"))}
    sides = [f(F.when(side, c)).alias(f"{k}_{i}") for i, side in enumerate((there, ~there)) for k, (f, c) in made.items()]
    g = edges.where("src is not null and dst is not null").groupBy(*unordered_pair()).agg(*sides)
    of = lambda x, y: F.when(F.col("_side") == 0, F.col(x)).otherwise(F.col(y))
    both = g.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
    both = both.select(of("a", "b").alias("src"), of("b", "a").alias("dst"), *(of(f"{k}_0", f"{k}_1").alias(f"_{k}") for k in made)).where("_n > 0")
    return both.select("src", "dst", "_best.chunk_id", *(F.col(f"_like.{c}") for c in rest), F.col("_sum").alias("weight")).select(*edges.columns)


def pruned(edges: DataFrame, threshold: float = 0.01) -> DataFrame:
    return edges.where(F.col("weight") >= threshold)


def directed_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, n): how often each directed pair is seen.  Both directions of a pair are one row on the way."""
    there = F.col("src") <= F.col("dst")
    n = edges.where("src is not null and dst is not null").groupBy(*unordered_pair()).agg(F.count_if(there).alias("there"), F.count_if(~there).alias("back"))
    return n.select(F.stack(F.lit(2), F.col("a"), F.col("b"), F.col("there"), F.col("b"), F.col("a"), F.col("back")).alias("src", "dst", "n")).where("n > 0")


def top_neighbours(state: GraphState, k: int) -> DataFrame:
    """(id, neighbor, count, place): the k most frequent neighbours of every entity."""
    n = directed_counts(state.edges).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), F.col("n").alias("count"))
    order = Window.partitionBy("id").orderBy(F.desc("count"), "neighbor")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def rank_listing(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in order with their ``place``, from 1."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over k rows


def share_of_top(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``share``: a column over its largest value, which counts as 1 where it is 0."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.join(top).withColumn("share", F.col(column) / F.when(F.col("_top") == 0, 1).otherwise(F.col("_top"))).drop("_top")


def last_seen(state: GraphState) -> DataFrame:
    """(id, last_seen): the latest dated edge, else the entity's update."""
    latest = state.edges.groupBy(F.col("src").alias("id")).agg(F.max("timestamp").alias("latest"))
    return state.entities.select("id", "updated_at").join(latest, "id", "left").select("id", F.coalesce("latest", "updated_at").alias("last_seen"))


def pair_counts(edges: DataFrame) -> DataFrame:
    """(a, b, n): how often each ordered pair is seen, counting an edge from both its ends; edges without an end are left out."""
    n = edges.where("src is not null and dst is not null").groupBy(*unordered_pair()).agg(F.count(F.lit(1)).alias("n"))
    ends = lambda c, d, n: F.struct(F.col(c).alias("a"), F.col(d).alias("b"), n.alias("n"))
    return n.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(ends("a", "b", 2 * F.col("n")))).otherwise(F.array(ends("a", "b", F.col("n")), ends("b", "a", F.col("n"))))))


def distinct_edge_count(edges: DataFrame) -> DataFrame:
    return edges.select(*unordered_pair(), "chunk_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def cross_project_entities(state: GraphState) -> DataFrame:
    """(id, projects): entities whose documents are sessions of more than one project, the projects sorted."""
    p = state.entity_documents.select(F.col("entity_id").alias("id"), session_project(F.col("document")).alias("project")).where("project is not null")
    return p.groupBy("id").agg(F.array_sort(F.collect_set("project")).alias("projects")).where(F.size("projects") > 1)


def goal_status(state: GraphState, now: int, stale_days: int = 30, kind: str = "Goal") -> DataFrame:
    """(id, mentions, latest, status) of goals with a chunk: unknown, stale or active."""
    goals = state.entities.where(F.col("entity_type") == kind).select("id")
    own = goals.join(state.mentions.select(F.col("entity_id").alias("id"), "chunk_id"), "id").join(state.chunks.select(F.col("id").alias("chunk_id"), "timestamp"), "chunk_id")
    g = own.groupBy("id").agg(F.count(F.lit(1)).alias("mentions"), F.max("timestamp").alias("latest"))
    return g.withColumn("status", F.when(F.col("latest").isNull(), "unknown").when(F.col("latest") < now - stale_days * 86400, "stale").otherwise("active"))


def low_access_count(state: GraphState, threshold: int = 5) -> DataFrame:
    return state.entities.agg(F.count_if(F.col("access_count") < threshold).alias("n"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def hops_of_chunks(chunks: DataFrame, hops: DataFrame, far: int = 99) -> DataFrame:
    """(id, min_hop): the nearest of each chunk's tags, ``far`` for none."""
    each = chunks.select("id", F.explode_outer("tags").alias("tag")).join(hops.select(F.col("id").alias("tag"), "hop"), "tag", "left")
    return each.groupBy("id").agg(F.min(F.coalesce("hop", F.lit(far))).alias("min_hop"))


def within_budget(rows: DataFrame, tokens: Column, budget: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """The rows in order up to the first that would pass the budget."""
    w = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def last_within_budget(rows: DataFrame, size: Column, budget: int, newest_first: list[Column], group: list[str]) -> DataFrame:
    """The newest rows of each group within the budget, one at least."""
    w = Window.partitionBy(*group).orderBy(*newest_first)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("place") == 1))


def greedy_packed(candidates: Column, budget: int) -> Column:
    """Of an array of structs (id, tokens, ...) the ones taken in order, each if it still fits."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    step = lambda s, c: F.when(
        s["used"] + c["tokens"] <= budget, F.struct((s["used"] + c["tokens"]).cast("long").alias("used"), F.concat(s["ids"], F.array(c["id"])).alias("ids"))
    ).otherwise(s)
    return F.aggregate(candidates, zero, step)


def top_by_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)
