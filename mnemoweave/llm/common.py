"""What several operators of this subpackage share: shared storage, folds, sorted runs, bit counts, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set here only where there is none, as in local tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mw-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` written to a table in the shared folder and read again, which cuts the lineage and packs columns.

    ``group_bytes`` bounds what a task gathers before it writes, where rows are large.
    """
    path = f"{shared_folder(df.sparkSession)}/mw-{uuid4().hex}"
    df.write.options(**({"parquet.block.size": group_bytes} if group_bytes else {})).parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def in_buckets(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` as a ``stored`` table in as many buckets of ``key`` as there are shuffle partitions: joins by it leave them where they are."""
    spark, name = df.sparkSession, f"mw_{uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    out = spark.table(name)
    out._stored_at, out._table = path, name
    return out


def _forget(spark: SparkSession, name: str, path: str) -> None:
    with suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that are not read again, and of shuffles whose plans are gone by now."""
    for df in tables:
        if name := getattr(df, "_table", None):
            _forget(df.sparkSession, name, df._stored_at)
        else:
            _remove(df.sparkSession, df._stored_at)
    if spark := SparkSession.getActiveSession():
        for wait in (1.0, 0.5):  # the context's cleaner removes the shuffles of collected plans, which end-of-query events hold for a moment
            time.sleep(wait)
            spark.sparkContext._jvm.System.gc()


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, after which the worker gives memory back: workers are kept, and what they hold counts for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)

    return run


def fold_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def sql_crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in SQL, half a byte at a time, low half first."""
    steps = list(range(16))  # what four shifts by the polynomial make of half a byte
    for _ in range(4):
        steps = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in steps]
    halves = f"list_transform(range(1, length(hex({text})) + 1), lambda i: instr('0123456789ABCDEF', substr(hex({text}), CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1)) - 1)"
    return f"xor(list_reduce({halves}, lambda c, x: xor(c >> 4, {steps}[(xor(c, x) & 15) + 1]), 4294967295), 4294967295)"


def sample_order(doc_id: str) -> list[Column]:
    """A fixed pseudo-random order of rows, the same for any partitioning."""
    return [F.xxhash64(F.col(doc_id)), F.col(doc_id)]


# Every byte's bits, each spread to one byte of a 64-bit lane.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)
_LANE_ROWS = 255  # a byte counts no further
_FEW = 15


def _majority_of_few(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The bits set in over half of ``n`` adjacent hashes, from each ``start`` on: 64 counts at a time, digit by digit."""
    digits: list[np.ndarray] = []
    for j in range(n):
        carry = hashes[start + j]
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        if (j + 1).bit_count() == 1:  # a further digit, which counts so far had not
            digits.append(carry)
    over, carry = (1 << len(digits)) - (n // 2 + 1), np.zeros(len(start), np.uint64)
    for k, digit in enumerate(digits):  # a count above half runs over when this is added
        carry = digit | carry if over >> k & 1 else digit & carry
    return carry


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash: for consecutive groups of 64-bit hashes, the bits set in over half of a group (0 for an empty one)."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    size = np.asarray(lengths, dtype=np.int64)
    start = np.cumsum(size) - size
    for n in range(1, _FEW + 1):
        few = np.flatnonzero(size == n)
        if len(few):
            out[few] = _majority_of_few(hashes, start[few], n)
    full = np.flatnonzero(size > _FEW)
    if not len(full):
        return out
    hashes, size = hashes[np.repeat(size > _FEW, size)], size[full]
    start = np.cumsum(size) - size
    pieces = (size + _LANE_ROWS - 1) // _LANE_ROWS
    first = np.cumsum(pieces) - pieces
    sub = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * _LANE_ROWS
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros(len(full), dtype=np.uint64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], sub).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for k in range(8):
            bits |= (counts[:, k] * 2 > size).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = bits
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Cut batches sorted by their first ``keys`` columns into (whole, columns) pieces.

    A piece with ``whole`` true holds complete runs only; a run of over ``most`` rows comes as pieces with ``whole``
    false, so that no more than about two batches are held however long a run gets.
    """
    held: list[np.ndarray] | None = None
    spilling: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if spilling is not None:
            same = np.ones(len(cols[0]), bool)
            for c, v in zip(cols, spilling):
                same &= c == v
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                yield False, [c[:n] for c in cols]
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            spilling = None
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        change[0] = True
        at = np.flatnonzero(change)
        last = at[-1]
        ends = np.append(at[1:], len(change))
        long = (ends - at) > most
        long_last = bool(long[-1])
        for i in np.flatnonzero(long):
            yield False, [c[at[i] : ends[i]] for c in cols]
        if long.any():
            keep = np.repeat(~long, ends - at)
            keep[last:] = False
            if keep.any():
                yield True, [c[keep] for c in cols]
        elif last:
            yield True, [c[:last] for c in cols]
        if long_last:
            spilling, held = tuple(c[last] for c in cols[:keys]), None
        else:
            held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield True, held


def hot_keys_split(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Give every row of ``rows`` the pairs (_i, _j) of pieces of its key it takes part in.

    A key with n rows is cut into ceil(n / most) pieces by the hash of ``member``; comparing within all (_i, _j) covers
    every pair of the key's rows, in groups of about 2 * ``most`` rows at the most.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", F.ceil(F.col("_n") / most).cast("int")).drop("_n")
    mine = rows.join(sizes, key).withColumn("_m", F.pmod(F.xxhash64(member), F.col("_p")).cast("int"))
    mine = mine.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    return mine.withColumns({"_i": F.least("_m", "_o"), "_j": F.greatest("_m", "_o")}).drop("_m", "_o", "_p")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root) with the smallest reachable node as root, by alternating stars.

    ``edges`` has two columns of one orderable type; self-loops and repeats are allowed, nulls are dropped.  Nodes
    without a partner do not appear.  Every round is written to the shared checkpoint folder, and rounds stop when
    the edge set, then a forest of stars, no longer changes.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
