"""The file graph of a repository: build, updates, neighbourhoods, ranked map, packed context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import combined_score, distance_weight, language_of, stars
from mnemoweave.operators.aggregates import greedy_packed
from mnemoweave.operators.lookups import noise_file
from mnemoweave.storage import materialise


class RepoState(NamedTuple):
    files: DataFrame  # path, language, content, content_hash
    edges: DataFrame  # src, dst, kind
    defs: DataFrame  # symbol, path
    uses: DataFrame  # path, symbol
    waiting: DataFrame  # target, importer: imports of files that are not there


def built(contents: DataFrame) -> RepoState:
    """From (path, content): files of known languages with a content hash; no edges."""
    spark = contents.sparkSession
    files = contents.select("path", language_of(F.col("path")).alias("language"), "content", F.xxhash64("content").alias("content_hash")).where("language <> 'Unknown'")
    empty = lambda s: spark.createDataFrame([], s)
    return RepoState(files, empty("src string, dst string, kind string"), empty("symbol string, path string"), empty("path string, symbol string"), empty("target string, importer string"))


def upserted_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """One edge for each (src, dst); an Import stands over a SymbolUsage."""
    return edges.unionByName(new).groupBy("src", "dst").agg(F.min_by("kind", F.when(F.col("kind") == "Import", 0).otherwise(1)).alias("kind"))


def with_file(repo: RepoState, added: DataFrame) -> RepoState:
    """With files (path, content) in place of those of the same path; imports that wait for them become edges."""
    fresh = built(added).files
    files = repo.files.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
    met = repo.waiting.join(fresh.select(F.col("path").alias("target")), "target", "left_semi")
    edges = upserted_edges(repo.edges, met.select(F.col("importer").alias("src"), F.col("target").alias("dst"), F.lit("Import").alias("kind")))
    return repo._replace(files=files, edges=edges, waiting=repo.waiting.join(fresh.select(F.col("path").alias("target")), "target", "left_anti"))


def without_files(repo: RepoState, paths: DataFrame) -> RepoState:
    """Without files (path), their edges and symbols; files that import them wait again."""
    p = paths.select("path").distinct()
    by = lambda df, c: df.join(p.withColumnRenamed("path", c), c, "left_anti").select(*df.columns)
    importers = repo.edges.where("kind = 'Import'").join(p.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("importer"))
    waiting = by(repo.waiting, "importer").unionByName(by(importers, "importer").distinct())
    return RepoState(by(repo.files, "path"), by(by(repo.edges, "src"), "dst"), by(repo.defs, "path"), by(repo.uses, "path"), waiting)


def statistics(repo: RepoState) -> DataFrame:
    """One row of counts: files, edges by kind, symbols, files with usages, waiting imports."""
    count = lambda df, *c: df.agg(*c)
    return (
        count(repo.files, F.count(F.lit(1)).alias("files"))
        .join(count(repo.edges, F.count_if(F.col("kind") == "Import").alias("imports"), F.count_if(F.col("kind") == "SymbolUsage").alias("usages")))
        .join(count(repo.defs, F.countDistinct("symbol").alias("symbols")))
        .join(count(repo.uses, F.countDistinct("path").alias("files_with_usages")))
        .join(count(repo.waiting, F.count(F.lit(1)).alias("unresolved")))
    )


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path"), "kind")


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path"), "kind")


def unresolved(repo: RepoState, n: int) -> DataFrame:
    """(target, waiters) of a few paths that imports wait for."""
    return repo.waiting.groupBy("target").agg(F.countDistinct("importer").alias("waiters")).orderBy("target").limit(n)


def inconsistencies(repo: RepoState) -> DataFrame:
    """(what, path): ends of edges and paths of symbols that are no files."""
    known = repo.files.select("path")
    ends = repo.edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    symbols = repo.defs.select("path").unionByName(repo.uses.select("path")).distinct()
    return ends.join(known, "path", "left_anti").select(F.lit("edge").alias("what"), "path").unionByName(symbols.join(known, "path", "left_anti").select(F.lit("symbol").alias("what"), "path"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, processed: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(path, hop, weight) around files (path) in both directions; Import edges are followed from the start only."""
    both = edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    seen = start.select("path").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        steps = both if hop == 1 else both.where("kind <> 'Import'")
        new = seen.where(F.col("hop") == hop - 1).join(steps, F.col("path") == F.col("src")).select(F.col("dst").alias("path")).distinct().join(seen.select("path"), "path", "left_anti")
        seen = seen.unionByName(new.withColumn("hop", F.lit(hop)))
        if hop < hops:
            seen = materialise(seen)
    out = seen.where("hop > 0")
    if processed is not None:
        out = out.join(processed.select("path"), "path", "left_anti")
    out = out.withColumn("weight", distance_weight(F.col("hop")))
    return out.orderBy(F.desc("weight"), "path").limit(cap) if cap is not None else out


def ranked_map(files: DataFrame, edges: DataFrame, ranks: DataFrame, top: int) -> DataFrame:
    """(path, rank, stars, dependents): the top files."""
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("dependents"))
    best = ranks.agg(F.max("rank").alias("top"))
    rows = files.select("path").join(ranks.withColumnRenamed("id", "path"), "path", "left").join(best).join(into, "path", "left")
    rank = F.coalesce("rank", F.lit(0.0))
    return rows.select("path", rank.alias("rank"), stars(rank, F.col("top")).alias("stars"), F.coalesce("dependents", F.lit(0)).alias("dependents")).orderBy(F.desc("rank"), "path").limit(top)


def map_text(ranked: DataFrame) -> str:
    """Ranked files as lines, and the tree of their folders.  The rows are those of one ``ranked_map``."""
    rows = ranked.collect()
    lines = [f"{r['stars']} {r['path']} ({r['dependents']} dependents)" for r in rows]
    tree, open_at = [], []
    for r in sorted(rows, key=lambda r: r["path"].split("/")):
        *folders, name = r["path"].split("/")
        for depth, folder in enumerate(folders):
            if open_at[: depth + 1] != folders[: depth + 1]:
                tree.append("  " * depth + folder + "/")
                open_at = folders[: depth + 1]
        tree.append("  " * len(folders) + f"{name} {r['stars']}")
    return "\n".join(["# Files", *lines, "", "# Tree", *tree])


def adaptive(files: int, budget: int) -> dict[str, int]:
    """Map tokens, anchors, listed files and the cap of a neighbourhood by the number of files."""
    return {"map_tokens": int(budget * 0.08), "anchors": min(max(files // 10, 3), 10), "listed": min(max(files // 4, 20), 75), "neighbours": min(max(files // 5, 10), 40)}


def packed(candidates: DataFrame, budget: int) -> DataFrame:
    """(used, ids): of rows (id, tokens, place), a capped candidate list, those taken in order while they fit."""
    row = F.array_sort(F.collect_list(F.struct("place", "id", "tokens")))
    return candidates.agg(greedy_packed(row, budget).alias("x")).select("x.used", "x.ids")


EXTENDED_FILES, SPARSE = 100, 20  # files one step further on, and how few of them are filled up
SIMILAR_FILES, RANKED_FILES = 50, 100  # that fill them up


def context_files(repo: RepoState, ranks: DataFrame, similar: DataFrame, anchors: int, neighbours: int, explicit: DataFrame | None = None, hops: int = 2) -> DataFrame:
    """(path, tier, score) of files for a question's context, each in its first tier.

    0: files asked for.  1: ``anchors`` of the most similar, by similarity and rank.  2: what is around them.  3: what is one
    step from all of those.  Where tier 3 is sparse, 4: more of the similar ones, and if it still is, 5: those of the
    highest rank.
    """
    ranked = ranks.withColumnRenamed("id", "path")
    top = ranks.agg(F.max("rank").alias("top"))
    pool = similar.orderBy(F.desc("similarity"), "path").limit(3 * anchors)
    score = combined_score(F.col("similarity").cast("double"), F.coalesce("rank", F.lit(0.0)), F.coalesce("top", F.lit(0.0)))
    close = pool.join(ranked, "path", "left").join(top).select("path", F.lit(1).alias("tier"), score.alias("score")).orderBy(F.desc("score"), "path").limit(anchors)
    asked = (explicit if explicit is not None else repo.files.limit(0)).select("path", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    start = materialise(asked.unionByName(close))
    near = materialise(neighbourhood(repo.edges, start, hops, start, neighbours).select("path", F.lit(2).alias("tier"), F.col("weight").alias("score")))
    found = start.unionByName(near)
    more = materialise(neighbourhood(repo.edges, found, 1, found, EXTENDED_FILES).select("path", F.lit(3).alias("tier"), F.col("weight").alias("score")))
    if more.count() < SPARSE:
        more = more.unionByName(similar.orderBy(F.desc("similarity"), "path").limit(SIMILAR_FILES).select("path", F.lit(4).alias("tier"), F.col("similarity").cast("double").alias("score")))
        more = materialise(more.join(found.select("path"), "path", "left_anti"))
        if more.select("path").distinct().count() < SPARSE:
            more = more.unionByName(ranked.orderBy(F.desc("rank"), "path").limit(RANKED_FILES).select("path", F.lit(5).alias("tier"), F.col("rank").alias("score")))
    best = found.unionByName(more).groupBy("path").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("k"))
    return best.select("path", "k.tier", (-F.col("k.s")).alias("score"))


def context(repo: RepoState, ranks: DataFrame, similar: DataFrame, budget: int, explicit: DataFrame | None = None, hops: int = 2) -> str:
    """A repository's context for a question: the ranked map, then the files of ``context_files`` while they fit; noise and
    blank files are left out."""
    p = adaptive(repo.files.count(), budget)
    shown = map_text(ranked_map(repo.files, repo.edges, ranks, p["listed"]))[: p["map_tokens"] * 4]
    chosen = context_files(repo, ranks, similar, p["anchors"], p["neighbours"], explicit, hops)
    rows = chosen.join(repo.files, "path").where((F.trim("content") != "") & ~noise_file(F.col("path"), F.col("content")))
    order = Window.orderBy("tier", F.desc("score"), "path")  # over as many rows as the tiers hold at most
    rows = materialise(rows.select(F.col("path").alias("id"), "content", F.ceil(F.length("content") / 4).cast("int").alias("tokens"), F.row_number().over(order).alias("place")))
    taken = packed(rows, budget - p["map_tokens"]).first()["ids"]
    texts = {r["id"]: r["content"] for r in rows.where(F.col("id").isin(taken)).collect()}
    return "\n\n".join([shown, *(f"## {i}\n{texts[i]}" for i in taken)])
