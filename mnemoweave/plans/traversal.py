"""Breadth-first traversal: one loop of joins for all start nodes, with the visited table cut at every hop."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.operators.relations import induced
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise, narrow


def expand(edges: DataFrame, start: DataFrame, hops: int, per_anchor: bool = False) -> DataFrame:
    """(anchor, id, hop) reached from (anchor, id) rows over directed (src, dst) rows within ``hops``.

    Without ``per_anchor`` all starts are one frontier and anchor is null.  The frontier meets all edges and only what it
    reaches is made distinct.
    """
    keys = ["anchor", "id"]
    seen = start.select(F.col("anchor") if per_anchor else F.lit(None).cast("string").alias("anchor"), "id").distinct().withColumn("hop", F.lit(0))
    if hops > 1:
        seen = materialise(seen)
    steps = edges.select(F.col("src").alias("id"), "dst")
    if hops > 1:  # edges may be a view that is dear to make
        steps = steps.persist(StorageLevel.MEMORY_AND_DISK)
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1)
        if hops > 1:  # few rows meet all edges where these are
            frontier = narrow(frontier)
        reached = frontier.join(steps, "id").select("anchor", F.col("dst").alias("id")).distinct()
        old = seen.select(F.col("anchor").alias("a"), F.col("id").alias("i"))
        new = reached.join(old, F.col("anchor").eqNullSafe(F.col("a")) & (F.col("id") == F.col("i")), "left_anti")
        seen = seen.unionByName(new.select(*keys).withColumn("hop", F.lit(hop)))
        if hops > 1:
            seen = materialise(seen)
    if hops > 1:
        steps.unpersist()
    return seen


def in_time(edges: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Edges to follow: with any bound only dated ones inside it."""
    if start is None and end is None:
        return edges
    held = F.col("timestamp").isNotNull()
    if start is not None:
        held &= F.col("timestamp") >= start
    if end is not None:
        held &= F.col("timestamp") <= end
    return edges.where(held)


def neighbourhood(state: GraphState, entity_id: str, hops: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(id, hop) within ``hops`` of an entity; empty for an unknown one.  The time bounds hold for traversal only."""
    first = state.entities.where(F.col("id") == entity_id).select(F.lit(None).cast("string").alias("anchor"), "id")
    return expand(in_time(state.edges, start, end), first, hops).select("id", "hop")


def subgraph(state: GraphState, entity_id: str, hops: int, start: int | None = None, end: int | None = None, strict_time: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, chunks) around an entity; edges and chunks are those of the members, whatever their time.

    ``strict_time`` bounds edges and chunks as well.
    """
    members = materialise(neighbourhood(state, entity_id, hops, start, end))
    edges, chunks = induced(state, members)
    if strict_time:
        edges, chunks = in_time(edges, start, end), in_time(chunks, start, end)
    return state.entities.join(members.select("id"), "id", "left_semi"), edges, chunks


def hops_over(edges: DataFrame, anchors: DataFrame, most: int = 10) -> DataFrame:
    """(id, hop) by undirected traversal of a small edge table from all anchors."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return expand(both, anchors.select(F.lit(None).cast("string").alias("anchor"), "id"), most).select("id", "hop")
