"""Joins of vectors by cosine similarity: exact over bounded blocks, or by random hyperplanes in several tables.

Rows are (id string, kind string, vector array<double>); pairs are (a, b, similarity) of one kind with a < b.  Vectors
that are null, empty or of no length take no part, nor does a null id; vectors of other dimensions than most are left
out, since a cosine needs like ones.  Ids stand once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.storage import materialise

PIVOTS = 128  # vectors that the driver and every task hold
BLOCK_ROWS = 2048
BUCKET_ROWS = 8  # that a table's buckets should hold
MISSED = 0.01  # share of pairs just at the threshold that hyperplanes may miss
SEED = 42
_SLACK = 1e-9  # of angles, for rounding
PAIRS = "a string, b string, similarity double"


def units(vectors: DataFrame) -> DataFrame:
    """(id, kind, unit): vectors cut to length one."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    whole = vectors.where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    whole = whole.select("id", F.coalesce("kind", F.lit("")).alias("kind"), F.col("vector").cast("array<double>").alias("vector")).withColumn("_len", norm).where("_len > 0")
    unit = whole.select("id", "kind", F.transform("vector", lambda x: x / F.col("_len")).alias("unit"))
    usual = unit.groupBy(F.size("unit").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return unit.where(F.size("unit") == (usual["d"] if usual else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def exact_pairs(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of ``threshold`` or more.

    Each vector joins its nearest pivot; a cluster's vectors lie within a known angle of it.  Clusters are cut into blocks
    by the hash of the id.  Two clusters meet only if their pivots are no further apart than their angles and that of
    the threshold allow, and only blocks of such clusters are multiplied, two blocks in a task.  What is not clustered is
    compared whole, in bounded tasks; pairs below the threshold never leave them.
    """
    rows = materialise(units(vectors))
    held = [r["unit"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not held:
        return rows.sparkSession.createDataFrame([], PAIRS)
    at = np.array(held)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(2)) @ at.T
                best = near.argmax(1)
                angle = _angle(near[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], names=["id", "kind", "unit", "cluster", "angle"])

    placed = materialise(rows.mapInArrow(nearest, "id string, kind string, unit array<double>, cluster int, angle double"))
    clusters = placed.groupBy("kind", "cluster").agg(F.max("angle").alias("reach"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    between = _angle(at @ at.T)
    near = [(i, j, float(between[i, j])) for i in range(len(at)) for j in range(i, len(at))]
    near = rows.sparkSession.createDataFrame(near, "c1 int, c2 int, apart double")  # as many rows as pairs of pivots
    side = lambda k: clusters.select("kind", *[F.col(c).alias(f"{x}{k}") for c, x in (("cluster", "c"), ("reach", "reach"), ("parts", "parts"))])
    met = near.join(side(1), "c1").join(side(2), ["kind", "c2"])
    met = met.where((F.col("c1") == F.col("c2")) | (F.col("apart") <= F.col("reach1") + F.col("reach2") + math.acos(max(-1.0, min(1.0, threshold))) + _SLACK))
    met = met.select("kind", "c1", "c2", F.explode(F.sequence(F.lit(0), F.col("parts1") - 1)).alias("p1"), "parts2")
    cells = materialise(met.select("kind", "c1", "p1", "c2", F.explode(F.sequence(F.when(F.col("c1") == F.col("c2"), F.col("p1")).otherwise(F.lit(0)), F.col("parts2") - 1)).alias("p2")))

    part = placed.join(clusters.select("kind", "cluster", "parts"), ["kind", "cluster"]).select("kind", F.col("cluster").alias("c"), F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int").alias("p"), "id", "unit")
    first = part.join(cells.withColumnsRenamed({"c1": "c", "p1": "p"}), ["kind", "c", "p"]).select("kind", F.col("c").alias("c1"), F.col("p").alias("p1"), "c2", "p2", "id", "unit")
    second = part.join(cells.withColumnsRenamed({"c2": "c", "p2": "p"}), ["kind", "c", "p"]).select("kind", "c1", "p1", F.col("c").alias("c2"), F.col("p").alias("p2"), "id", "unit")

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        x, y = _matrix(left["unit"]), _matrix(right["unit"])
        dots = x @ y.T
        i, j = np.nonzero(dots >= threshold)
        ids = [np.array(t["id"].to_pylist(), dtype=object) for t in (left, right)]
        a, b = ids[0][i], ids[1][j]
        same = (left["c1"][0].as_py(), left["p1"][0].as_py()) == (left["c2"][0].as_py(), left["p2"][0].as_py())
        keep = a < b if same else a != b
        a, b, s = a[keep], b[keep], dots[i, j][keep]
        swap = a > b
        return pa.table({"a": pa.array(np.where(swap, b, a), pa.string()), "b": pa.array(np.where(swap, a, b), pa.string()), "similarity": pa.array(s)})

    cell = ["kind", "c1", "p1", "c2", "p2"]
    second = second.select(*[F.col(c).alias(c) for c in second.columns])  # both sides stem from the same rows
    return first.groupBy(*cell).cogroup(second.groupBy(*cell)).applyInArrow(hits, PAIRS)


def tables_for(rows: int, threshold: float, missed: float = MISSED, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(hyperplanes of a table, tables): a pair at the threshold falls on one side of a plane with 1 - angle / pi."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    planes = min(60, max(1, math.ceil(math.log2(max(2, rows / bucket_rows)))))
    return planes, max(1, math.ceil(math.log(missed) / math.log1p(-min(agree**planes, 1 - 1e-12))))


@cache
def _planes(dimensions: int, planes: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, planes * tables))


def hashed_pairs(vectors: DataFrame, threshold: float, missed: float = MISSED, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """Pairs of ``threshold`` or more that share a bucket of a table; at the threshold itself a share of ``missed`` is expected not to.

    Vectors that are alike in every component are one class: they meet others by their smallest id, and each of them is
    paired with that id (similarity 1), so that copies do not pair among themselves.  Ids travel, not vectors, until
    candidates are verified once each.
    """
    rows = units(vectors).withColumns({"h1": F.xxhash64("kind", "unit"), "h2": F.xxhash64(F.lit(1), "kind", "unit")})
    rows = materialise(rows)
    heads = materialise(rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "kind", "unit")).alias("x"), F.count(F.lit(1)).alias("n")).select("h1", "h2", "x.*", "n"))
    planes, tables = tables_for(max(1, heads.count()), threshold, missed, bucket_rows)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                sides = (x @ _planes(x.shape[1], planes, tables, seed) > 0).reshape(len(x), tables, planes)
                found = (sides @ weights).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, tables, dtype=np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=["id", "kind", "keys"])

    hashed = heads.select("id", "kind", "unit").mapInArrow(keys, "id string, kind string, keys array<long>")
    bucket = materialise(hashed.select("id", "kind", F.posexplode("keys").alias("table", "key")))
    met = bucket.withColumnRenamed("id", "a").join(bucket.withColumnRenamed("id", "b"), ["kind", "table", "key"]).where("a < b").select("a", "b").distinct()
    side = lambda x: heads.select(F.col("id").alias(x), F.col("unit").alias(f"unit_{x}"))
    dot = F.aggregate(F.zip_with("unit_a", "unit_b", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    found = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", dot.alias("similarity")).where(F.col("similarity") >= threshold)
    copies = heads.where("n > 1").select("h1", "h2", F.col("id").alias("a")).join(rows.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).where("a <> b")
    return found.unionByName(copies.select("a", "b", F.lit(1.0).alias("similarity")))
