"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts become sequences of word numbers (0: a word of no test string).  Test strings are the windows of 10 consecutive
item words, or the whole item where it has fewer; those of one length m share a table.  A block is two words (one where
m is 1): the shift table tells how far the search may jump when a block ends at the current word, buckets by the hash of
a window's last block select its candidates where the shift is zero, the hash of its first block and then a direct
comparison of all words confirm.  The jumps of many positions are taken side by side with numpy.

The tables are broadcast.  Their size is bounded: the benchmark's characters are counted first, and beyond about
``SLICE_WORDS`` words items are dealt by hash into slices.  Each slice is searched in a pass of its own, what it found is
written to the shared folder, and its tables are given up before those of the next are built.

A null text has no words.  An item of no word, or with a null item_id, takes part in nothing; equal item_ids count
once.  Repeated documents give repeated rows.  An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.llm.common import released, stored, table

WINDOW = 10
SLICE_WORDS = 2_000_000
LANES = 2048
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Patterns:
    """Shift tables, suffix buckets and words of the distinct test strings of one length."""

    def __init__(self, rows: np.ndarray, owners: list[np.ndarray]):
        self.rows, self.m = rows, rows.shape[1]
        self.block = min(2, self.m)
        self.bits = max(12, int(4 * len(rows) * self.m).bit_length())
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, dtype=np.uint8)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.hash(rows, end), np.uint8(self.m - 1 - end))
        suffix = self.hash(rows, self.m - 1)
        order = np.argsort(suffix, kind="stable")
        self.by_suffix = order
        self.start = np.zeros((1 << self.bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount(suffix, minlength=1 << self.bits), out=self.start[1:])
        self.prefix = self.hash(rows, self.block - 1)
        self.owner_start = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
        self.owners = np.concatenate(owners)

    def hash(self, seq: np.ndarray, end: int | np.ndarray) -> np.ndarray:
        """Of the block that ends at ``end``, in the last axis of ``seq``."""
        h = seq[..., end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            h += seq[..., end - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, test string) of every occurrence in ``seq``."""
        ends = len(seq)
        if ends < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane = max(4 * self.m, -(-ends // LANES))
        at = np.arange(self.m - 1, ends, lane)
        stop = np.minimum(at + lane, ends)
        stops = []
        while len(at):
            jump = self.shift[self.hash(seq, at)]
            hit = jump == 0
            if hit.any():
                stops.append(at[hit])
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(stops)
        h = self.hash(seq, at)
        n = self.start[h + 1] - self.start[h]
        where = np.repeat(at, n)
        which = self.by_suffix[np.repeat(self.start[h], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = self.hash(seq, where - self.m + self.block) == self.prefix[which]
        where, which = where[same], which[same]
        for k in range(self.m):
            same = seq[where - k] == self.rows[which, self.m - 1 - k]
            where, which = where[same], which[same]
        return where - self.m + 1, which


class Searcher:
    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(WINDOW, len(seq))
            for i in range(len(seq) - m + 1 if m else 0):
                windows.setdefault(m, {}).setdefault(tuple(seq[i : i + m]), set()).add(number[item])
        self.patterns = [Patterns(np.array(list(w), dtype=np.int32), [np.array(sorted(o)) for o in w.values()]) for _, w in sorted(windows.items())]

    def search(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each document the numbers of its hit words, and the ids of the items that occur."""
        get = self.vocabulary.get
        start = np.cumsum([0, *(len(d) + 1 for d in docs)])
        seq = np.zeros(start[-1], dtype=np.int32)  # a zero ends each document
        for d, s in zip(docs, start):
            seq[s : s + len(d)] = [get(w, 0) for w in d]
        edge = np.zeros(len(seq) + 1, dtype=np.int32)
        items: list[set[int]] = [set() for _ in docs]
        for p in self.patterns:
            first, which = p.find(seq)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + p.m, -1)
            for d, k in set(zip((np.searchsorted(start, first, "right") - 1).tolist(), which.tolist())):
                items[d].update(p.owners[p.owner_start[k] : p.owner_start[k + 1]].tolist())
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cut = np.searchsorted(hit, start)
        return [hit[cut[d] : cut[d + 1]] - start[d] for d in range(len(docs))], [[self.ids[i] for i in sorted(x)] for x in items]


def mark(docs: DataFrame, benchmark: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` of each row, then n_words, hit_words array<int>, item_ids array<string> (sorted, distinct)."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-size // (5 * SLICE_WORDS)))
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), F.col("text").cast("string"), F.lit(0).cast("long"), F.array().cast("array<int>"), F.array().cast("array<string>")).toDF(*names, "_t", "_w", "_h", "_i")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for k in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast(Searcher([tuple(r) for r in mine.toLocalIterator()]))  # of one slice

        def search(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            found = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    docs = [words_of(x.as_py()) for x in b.column(b.num_columns - 4)]
                    hits, items = found.search(docs)
                    if not first:
                        hits = [np.union1d(h, np.array(o.as_py(), dtype=np.int64)) for h, o in zip(hits, b.column(b.num_columns - 2))]
                        items = [sorted({*i, *o.as_py()}) for i, o in zip(items, b.column(b.num_columns - 1))]
                    last = [pa.array([len(d) for d in docs], pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-3], *last], names=b.schema.names)

        rows = rows.mapInArrow(released(search), schema)
        if k < slices - 1:  # one slice's tables at a time
            rows = stored(rows)
            shared.destroy()
    return rows.drop("_t").toDF(*carry, "n_words", "hit_words", "item_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), o AS (
  SELECT doc_id, m, i, item_id FROM dw JOIN p USING (m, win)
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test string occurs; columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = mark(docs, benchmark, *docs.columns).toDF(*names, "n_words", "hit_words", "item_ids")  # columns of docs may have these names
    return found.where(F.size("hit_words") == 0).select(*names).toDF(*docs.columns)
