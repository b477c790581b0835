"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors hold floor(64 * x) of each component.  Candidates are dealt to shards and queries to groups; each pair of a group
and a shard is one task over bounded inputs.  In a shard, vectors close to each other are laid next to each other and cut
into document-range blocks.  A block keeps the largest and smallest value of every term and a forward index (its rows).
For each query the blocks are ordered by the sum of its terms' best products, then scored through the forward index until
that bound falls below the k-th score found; a bound equal to it is still scored, since ties go to the smaller id.

Vectors that are null, or hold a null or non-finite component, take no part, nor does a null id; shorter vectors count as
padded with zeros.  Rows that repeat an id are one candidate each, and never candidates of a query of the same id.
Products and their sums must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import table

K = 20
SHARD_ROWS = 8192
GROUP_QUERIES = 4096
BLOCK_ROWS = 128
PIVOTS = 32
_LOWEST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    col = column.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy()[col.offsets[0].as_py() : col.offsets[-1].as_py()]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max((len(x) for chunk in column.chunks for x in chunk), default=0)


def laid_out(rows: np.ndarray) -> np.ndarray:
    """An order of rows in which neighbours are alike: by the nearest of a few pivot rows, then by closeness to it."""
    pivots = rows[:: max(1, len(rows) // PIVOTS)].astype(np.float64)
    near = rows.astype(np.float64) @ pivots.T / (np.linalg.norm(pivots, axis=1) + 1e-9)
    best = near.argmax(1)
    return np.lexsort((-near[np.arange(len(rows)), best], best))


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest_query: int):
        order = laid_out(rows)
        self.ids, rows = ids[order], rows[order]
        exact = rows.shape[1] * int(np.abs(rows).max(initial=0)) * largest_query
        self.kind = np.float32 if exact < 1 << 24 else np.float64 if exact < 1 << 53 else np.int64
        self.rows = rows.astype(self.kind)
        cut = np.arange(0, len(rows), BLOCK_ROWS)
        self.blocks = list(zip(cut, np.append(cut[1:], len(rows))))
        self.top = np.maximum.reduceat(self.rows, cut, axis=0)
        self.low = np.minimum.reduceat(self.rows, cut, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids) of the best k for each query, best first, and how many blocks were scored for it."""
        q = queries.astype(self.kind)
        bound = np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(q)
        scores, ids = np.full((n, k), _LOWEST), np.full((n, k), np.iinfo(np.int64).max)
        used = np.zeros(n, np.int64)
        active = np.arange(n)
        for r in range(len(self.blocks)):
            block = order[active, r]
            alive = bound[active, block] >= scores[active, -1]
            active, block = active[alive], block[alive]
            if not len(active):
                break
            used[active] += 1
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by])) + 1
            for part in np.split(by, cuts):
                a, (s, e) = active[part], self.blocks[block[part[0]]]
                got = (q[a] @ self.rows[s:e].T).astype(np.int64)
                got[query_ids[a][:, None] == self.ids[None, s:e]] = _LOWEST
                better = (got >= scores[a, -1:]).any(1)
                if not better.any():
                    continue
                a, got = a[better], got[better]
                all_scores = np.concatenate([scores[a], got], axis=1)
                all_ids = np.concatenate([ids[a], np.broadcast_to(self.ids[s:e], got.shape)], axis=1)
                best = np.lexsort((all_ids, -np.maximum(all_scores, _LOWEST + 1)), axis=1)[:, :k]
                scores[a], ids[a] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
        return scores, ids, used


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised queries and candidates, both (vec_id, v)."""
    n_rows, n_queries = candidates.count(), queries.count()
    shards, groups = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // GROUP_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.withColumn("g", deal(groups)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = candidates.withColumn("s", deal(shards)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if q.num_rows and c.num_rows:
            width = max(_width(q["v"]), _width(c["v"]))
            qs, rows = _matrix(q["v"], width), _matrix(c["v"], width)
            query_ids, ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
            scores, found, _ = Shard(ids, rows, int(np.abs(qs).max(initial=0))).search(query_ids, qs, k)
            real = scores > _LOWEST
            out = {"query_id": pa.array(np.repeat(query_ids, k).reshape(scores.shape)[real]), "vec_id": pa.array(found[real]), "score": pa.array(scores[real])}
        return pa.table(out)

    per_shard = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = per_shard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows.where("vec_id % 20 = 0"), rows)


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 20
"""
