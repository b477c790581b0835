"""PageRank and what is ordered by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.schemas import FILE_EDGE_STRENGTHS
from mnemoweave.storage import materialise

#: Groups of nodes on either side of the transition table, nodes for which there is one, and nodes of a group at the most.
SIDES, SIDE_NODES, MOST_NODES = 8, 15_000, 4_000_000
#: Edges that a task packs at a time, and edges that a row of the transition table holds.
PACK_EDGES, PIECE_EDGES = 1 << 17, 1 << 19


def _packed(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    """One row: numbers as they are, arrays as their bytes."""
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes() if isinstance(c, np.ndarray) else c]) for c in columns], names=names.split())


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(id, h) of the distinct ids, null aside, with a hash that no two of them share, and its seed."""
    ids = materialise(nodes.select("id").distinct())
    for seed in range(42, 50):
        numbered = ids.where("id is not null").select("id", F.xxhash64("id", F.lit(seed)).alias("h"))
        if not numbered.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return ids, seed
    raise ValueError("ids whose hashes differ under none of eight seeds")


def _pieces(edges: DataFrame, seed: int, sides: int) -> DataFrame:
    """(block, s, d, w): edges by the groups of their ends, hashes and weights packed to rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            s, d, w = (np.concatenate(c) for c in zip(*held))
            block = (s % sides) * sides + d % sides
            order = np.argsort(block, kind="stable")
            s, d, w, block = s[order], d[order], w[order], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for low, high in zip(cuts, np.append(cuts[1:], len(block))):
                yield _packed("block s d w", int(block[low]), s[low:high], d[low:high], w[low:high])

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= PACK_EDGES:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    h = lambda end: F.xxhash64(end, F.lit(seed))
    rows = edges.where("src is not null").select(h("src").alias("s"), h("dst").alias("d"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    return rows.mapInArrow(pack, "block long, s binary, d binary, w binary")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, s, d, w, size): hashes as places among the sorted hashes of their groups, in rows of about ``PIECE_EDGES`` edges.

    Rows (block, at, s, d, w) are sorted: first the hashes of a block's sources, as s, then those of its other ends, as d,
    then its edges, so that a task holds the two groups of one block at a time.  Edges of unknown sources are left out; an unknown
    end of an edge goes to the place behind the last, ``size``.
    """
    block, hs, hd, held = None, np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def row() -> pa.RecordBatch:
        s, d, w = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(s, kind="stable")  # ranks are read in order
        return _packed("block s d w size", block, s[order], d[order], w[order], len(hd))

    for b in batches:
        for k, at, s, d, w in zip(*b.columns):
            if k.as_py() != block:
                if held:
                    yield row()
                block, hs, hd = k.as_py(), np.zeros(0, np.int64), np.zeros(0, np.int64)
            s, d = (np.frombuffer(c.as_buffer() or b"", np.int64) for c in (s, d))
            if at.as_py() == 0:
                hs = s.copy()  # not the whole batch
            elif at.as_py() == 1:
                hd = d.copy()
            elif len(hs):
                w, place, to = np.frombuffer(w.as_buffer()), np.minimum(np.searchsorted(hs, s), len(hs) - 1), np.searchsorted(hd, d)
                if len(hd):
                    to[hd[np.minimum(to, len(hd) - 1)] != d] = len(hd)
                known = hs[place] == s
                held.append((place[known].astype(np.int32), to[known].astype(np.int32), w[known]))
                if sum(len(x[0]) for x in held) >= PIECE_EDGES:
                    yield row()
    if held:
        yield row()


def _multiplied(sides: int):
    """(b, part) of pieces (block, s, d, w, size, u), u the ranks over out-weights of their sources: sums for the nodes of
    group b, of all that the task has of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, s, d, w, size, u in zip(*b.columns):
                s, d, w, u = (np.frombuffer(c.as_buffer(), t) for c, t in ((s, np.int32), (d, np.int32), (w, np.float64), (u, np.float64)))
                group, size = block.as_py() % sides, size.as_py()
                found = np.bincount(d, u[s] * w, size + 1)[:size]
                sums[group] = sums[group] + found if group in sums else found
        for group, found in sums.items():
            yield _packed("b part", group, found)

    return run


def _weighed(sides: int):
    """(b, part) of pieces: sums of weights for the nodes of group b, as far as the last source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, s, w in zip(*b.columns):
                group, found = block.as_py() // sides, np.bincount(np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(w.as_buffer()))
                sums[group] = _sum(sums[group], found) if group in sums else found
        for group, found in sums.items():
            yield _packed("b part", group, found)

    return run


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two vectors, of which one may be shorter."""
    out = np.zeros(max(len(a), len(b)))
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _summed(base: float | None, damping: float, start: float):
    """(b, size, out, rank, u) of rows (b, size, out, part): the sums of a group's parts as its ranks, and ranks over out-weights.

    Without ``base`` the sums are the out-weights and all ranks ``start``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for group, size, out, part in zip(*b.columns):
                mine = sums.setdefault(group.as_py(), [0, None, np.zeros(0)])
                if size.is_valid:
                    mine[:2] = size.as_py(), out.as_py()
                if part.is_valid:
                    mine[2] = _sum(mine[2], np.frombuffer(part.as_buffer()))
        for group, (size, out, total) in sums.items():
            total = _sum(total, np.zeros(size))
            out = total if base is None else np.frombuffer(out)
            rank = np.full(size, start) if base is None else base + damping * total
            u = np.divide(rank, out, out=np.zeros(size), where=~(out <= 0))
            yield _packed("b size out rank u", group, size, out, rank, u)

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank) of nodes (id) under weighted edges (src, dst, weight); a node without outgoing edges passes nothing on.

    Nodes are dealt by a hash, told apart among them, to a fixed number of groups, and edges to blocks by the groups of
    their two ends, packed to pieces with places in place of ids: a shuffle each.  The hashes of a block's two groups go ahead of
    its edges, once for each block, and a task holds those of one block.  Pieces are kept by block, on disk where
    memory is short.  An iteration shuffles vectors only, the ranks of a group once for each block of its row, and the sums
    of a block once: as many numbers as nodes times twice the groups, however many edges and partitions there are.
    Parallel edges add up.  An end that is no node counts for its source's sum of weights only; it would be taken for a node
    if their 64-bit hashes were equal.  Vectors are cut off their lineage now and then.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids, seed = _numbered(nodes)
    count = ids.count()
    if not count:
        return ids.select("id", F.lit(0.0).alias("rank"))
    sides = max(min(SIDES, -(-count // SIDE_NODES)), -(-count // MOST_NODES))
    base = (1 - damping) / count
    h = F.xxhash64("id", F.lit(seed))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            g, values = (c.to_numpy() for c in b.columns)
            for k in np.unique(g).tolist():
                held.setdefault(k, []).append(values[g == k])
        for k, values in held.items():
            known = np.sort(np.concatenate(values))
            yield _packed("b size h", k, len(known), known)

    known = ids.where("id is not null").select(F.pmod(h, F.lit(sides)).alias("b"), h.alias("h")).repartition(sides, "b").mapInArrow(hashes, "b long, size long, h binary")
    known = materialise(known)
    spread = lambda df, *values: df.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).select((F.col("b") * sides + F.col("o")).alias("block"), *values)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    sources = spread(known, F.lit(0).alias("at"), F.col("h").alias("s"), none("binary", "d"), none("binary", "w"))
    over = known.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    others = over.select((F.col("o") * sides + F.col("b")).alias("block"), F.lit(1).alias("at"), none("binary", "s"), F.col("h").alias("d"), none("binary", "w"))
    rows = _pieces(edges, seed, sides).select("block", F.lit(2).alias("at"), "s", "d", "w").unionByName(sources).unionByName(others)
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "at")
    step = rows.mapInArrow(_placed, "block long, s binary, d binary, w binary, size long")
    step = step.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)

    def summed(given: DataFrame, vectors: DataFrame, *how: float | None) -> DataFrame:
        rows = vectors.select("b", "size", "out", none("binary", "part")).unionByName(given.select("b", none("long", "size"), none("binary", "out"), "part"))
        return rows.repartition(sides, "b").mapInArrow(_summed(*how), "b long, size long, out binary, rank binary, u binary")

    given = step.select("block", "s", "w").mapInArrow(_weighed(sides), "b long, part binary")
    vectors = first = materialise(summed(given, known.withColumn("out", F.lit(None).cast("binary")), None, damping, 1.0 / count))
    for i in range(1, iterations + 1):
        given = step.join(spread(vectors, "u").hint("shuffle_hash"), "block").select("block", "s", "d", "w", "size", "u").mapInArrow(_multiplied(sides), "b long, part binary")
        vectors = summed(given, first, base, damping, 0.0)
        if i % cut_every == 0 or i == iterations:
            vectors = materialise(vectors)
    step.unpersist()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for known, rank in zip(*b.columns):
                known, rank = np.frombuffer(known.as_buffer(), np.int64), np.frombuffer(rank.as_buffer())
                for k in range(0, len(known), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(known[k : k + 10_000]), pa.array(rank[k : k + 10_000])], names=["h", "rank"])

    ranks = known.join(vectors, "b").select("h", "rank").mapInArrow(told, "h long, rank double")
    named = ids.withColumn("h", F.when(F.col("id").isNotNull(), h))
    return named.join(ranks, "h", "left").select("id", F.coalesce("rank", F.lit(base)).alias("rank"))


def file_edges_weighted(edges: DataFrame) -> DataFrame:
    """File edges (src, dst, kind) with their strengths as weight."""
    kind = F.create_map(*(F.lit(x) for kv in FILE_EDGE_STRENGTHS.items() for x in kv))
    return edges.select("src", "dst", kind[F.col("kind")].alias("weight"))


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "id").limit(k)
