"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are all runs of one to three words; a feature's bucket is the crc32 of its bytes, modulo a number of
buckets.  DuckDB works inside each partition: SQL extracts and unnests words, windows carry the checksum of the words
before, so that a run of words is never put together as text, and a registered zlib function goes on from it.  Bucket
counts of each document, and one row of totals of each task, are spilled to a Parquet table.  Spark merges the totals of
all documents and of the target texts to one gain for each bucket, scores the documents from their spilled counts, and
draws the best by weight plus Gumbel noise derived from the id.

Texts that are null or hold no word have no feature, the weight 0, and are not drawn; a null id is hashed as an empty one
and goes last among ties.  Rows that repeat an id are documents of their own.  Texts of any length are cut into pieces
between words.  Extra columns take no part.  An empty table gives no rows; with no target text all T and t are 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import released, sql_crc, stored, table
from mnemoweave.llm.ordered import running_totals

BUCKETS = 10_000
RUN_WORDS = 3
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
PIECE_CHARS = 400_000  # a longer text is cut between words
GROUP_BYTES = 16_000_000  # of spilled counts that a task gathers before it writes
SCORED_ROWS = 512  # whose counts are looked up at once
SLICE_CHARS = 400_000  # the pieces that one statement takes, at the least

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_BREAK = re.compile(f"[{re.escape(_BREAKS)}]")
_UPPER, _LOWER = (bytes(range(c, c + 26)).decode() for c in (65, 97))

#: The first ``skip`` words of a piece belong to the piece before and only stand ahead of others.
_COUNTS = """
WITH w AS (
  SELECT piece, text, skip, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT piece, text, skip, string_split(translate(body, $apart, $joined), ' ') AS words FROM slice)
), one AS (
  SELECT piece, text, skip, pos, encode(' ' || word) AS more, crc(encode(word)) AS c1 FROM w WHERE word <> ''
), two AS (
  SELECT *, crc_on(lag(c1) OVER s, more) AS c2 FROM one WINDOW s AS (PARTITION BY piece ORDER BY pos)
), three AS (
  SELECT *, crc_on(lag(c2) OVER s, more) AS c3 FROM two WINDOW s AS (PARTITION BY piece ORDER BY pos)
)
SELECT text, CAST(c % $buckets AS INTEGER) AS bucket, count(*) AS n FROM (SELECT text, unnest([c1, c2, c3]) AS c FROM three WHERE pos > skip) WHERE c IS NOT NULL GROUP BY ALL
"""
#: A document's counts are ``packed``: a bucket and its count after the other, as two bytes each; a larger count stands in
#: several pairs.  Totals of a task have lists.
_SPILL = "doc_id long, whole boolean, n_words long, n_features long, packed binary, buckets array<int>, counts array<long>"
_MOST = (1 << 16) - 1


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array(list(map(zlib.crc32, words.to_numpy())), pa.int64())


def _crc_on(before: pa.ChunkedArray, more: pa.ChunkedArray) -> pa.Array:
    """crc32 of what ``before`` is the checksum of, followed by ``more``."""
    return pa.array(list(map(zlib.crc32, more.to_numpy(), before.to_numpy().tolist())), pa.int64())


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """(piece, leading words that are the last of the piece before)."""
    at, ahead = 0, []
    while at < len(text):
        end = _BREAK.search(text, at + PIECE_CHARS)
        end = end.start() if end else len(text)
        body = text[at:end]
        yield " ".join([*ahead, body]), len(ahead)
        if end < len(text):
            ahead = [*ahead, *_WORD.findall(body)][1 - RUN_WORDS :]
        at = end


class _Counter:
    """Bucket counts of texts, a slice of them at a time."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.values = {"buckets": buckets, "apart": _BREAKS + _UPPER, "joined": " " * len(_BREAKS) + _LOWER}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.create_function("crc", _crc, ["BLOB"], "BIGINT", type="arrow")
        self.db.create_function("crc_on", _crc_on, ["BIGINT", "BLOB"], "BIGINT", type="arrow")
        self.total = np.zeros(buckets, np.int64)

    def add(self, pieces: list[tuple[int, str, int]], to: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Add the counts of pieces (text, body, skip) to ``to``: for each text its buckets and their counts."""
        text, body, skip = zip(*pieces)
        self.db.register("slice", pa.table({"piece": pa.array(range(len(text)), pa.int32()), "text": pa.array(text, pa.int64()), "skip": pa.array(skip, pa.int32()), "body": pa.array(body, pa.string())}))
        got = self.db.sql(_COUNTS, params=self.values).to_arrow_table()
        self.db.unregister("slice")
        if not got.num_rows:
            return
        text, bucket, n = (got.column(c).to_numpy().astype(np.int64) for c in ("text", "bucket", "n"))
        order = np.argsort(text * self.buckets + bucket)
        text, bucket, n = text[order], bucket[order], n[order]
        self.total += np.bincount(bucket, n, self.buckets).astype(np.int64)
        start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        for s, e in zip(start, np.append(start[1:], len(text))):
            found = (bucket[s:e], n[s:e])
            if before := to.get(int(text[s])):
                both = np.bincount(before[0], before[1], self.buckets) + np.bincount(found[0], found[1], self.buckets)
                full = np.flatnonzero(both)
                found = (full, both[full].astype(np.int64))
            to[int(text[s])] = found

    def totals(self) -> pa.RecordBatch:
        full = np.flatnonzero(self.total)
        one = lambda values, kind: pa.array([values], kind)
        row = [one(None, pa.int64()), one(True, pa.bool_()), one(0, pa.int64()), one(0, pa.int64()), one(None, pa.binary()), one(full, pa.list_(pa.int32())), one(self.total[full], pa.list_(pa.int64()))]
        self.total[:] = 0
        return pa.RecordBatch.from_arrays(row, names=_NAMES)


_NAMES = [c.split()[0] for c in _SPILL.split(", ")]


def _packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    times = -(-counts // _MOST)
    pairs = np.empty((int(times.sum()), 2), "<u2")
    pairs[:, 0] = np.repeat(buckets, times)
    pairs[:, 1] = _MOST
    pairs[np.cumsum(times) - 1, 1] = counts - (times - 1) * _MOST
    return pairs.tobytes()


def _spilled(ids: Sequence, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    features = np.array([c.sum() for _, c in found], np.int64)
    words = np.where(features > 1, features // RUN_WORDS + 1, features)  # n words have n + (n - 1) + (n - 2) runs
    lists = [pa.nulls(len(ids), pa.list_(kind)) for kind in (pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([False] * len(ids)), pa.array(words), pa.array(features), pa.array([_packed(*x) for x in found], pa.binary()), *lists], names=_NAMES)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The spilled counts: a row for each row of (doc_id, text) with ``whole`` false, and a row of totals for each task.

    A task holds one batch of texts, one slice of words, and the counts of the texts in it.  At most 65,536 buckets.
    """

    none = np.empty(0, np.int64)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(buckets)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            held, chars, given = [], 0, 0

            def rows(start: int, end: int) -> pa.RecordBatch:
                return _spilled(ids[start:end], [ready.pop(i, (none, none)) for i in range(start, end)])

            for i in range(len(ids)):
                for body, skip in _pieces(texts[i].as_py() or ""):
                    held.append((i, body, skip))
                    chars += len(body)
                    if chars >= SLICE_CHARS:
                        counter.add(held, ready)
                        held, chars = [], 0
                        if i > given:  # text i may go on
                            yield rows(given, i)
                            given = i
            if held:
                counter.add(held, ready)
            if given < len(ids):
                yield rows(given, len(ids))
            if counter.total.max(initial=0) > 1 << 30:
                yield counter.totals()
        if counter.total.any():
            yield counter.totals()
        counter.db.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _SPILL)


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the spilled counts of the documents and of the target texts."""
    merged = lambda df, name: df.where("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(merged(counts, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").na.fill(0)
    all_of = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0)))  # noqa: E731  over as many rows as buckets
    ratio = (F.col("t") + 1).cast("double") * (all_of("s") + buckets) / ((F.col("s") + 1).cast("double") * (all_of("t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(counts: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features; ``buckets`` gains go to the tasks."""
    held = np.zeros(buckets, np.int64)
    for bucket, value in gain.collect():
        held[bucket] = value

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(at, SCORED_ROWS)
                ends = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: batch.num_rows + 1]
                pairs = np.frombuffer(batch.column(3).buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u2").reshape(-1, 2)
                run = np.append(0, np.cumsum(held[pairs[:, 0]] * pairs[:, 1]))
                sums = run[(ends[1:] - ends[0]) // 4] - run[(ends[:-1] - ends[0]) // 4]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return counts.where("not whole").select("doc_id", "n_words", "n_features", "packed").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    ``target`` has a column text.
    """
    counts = stored(bucket_counts(docs, buckets), GROUP_BYTES)
    wanted = stored(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    scored = stored(weighted(counts, gains(counts, wanted, buckets), buckets).withColumn("score", F.col("weight") + noise))
    ranked = running_totals(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"])
    drawn = ranked.count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("_total") <= drawn, F.col("_total"))).drop("_total")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, TRUE AS mine, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), FALSE, NULL, text FROM benchmark
), lists AS (
  SELECT r, mine, doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS ws FROM texts
), words AS (
  SELECT r, mine, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists
), grams AS (
  SELECT r, mine, w AS g1, lag(w) OVER s || ' ' || w AS g2, lag(w, 2) OVER s || ' ' || lag(w) OVER s || ' ' || w AS g3 FROM words WINDOW s AS (PARTITION BY mine, r ORDER BY i)
), features AS (
  SELECT r, mine, unnest([g1, g2, g3]) AS g FROM grams
), known AS (
  SELECT g, {sql_crc("g")} % {BUCKETS} AS b FROM (SELECT DISTINCT g FROM features WHERE g IS NOT NULL)
), counted AS (
  SELECT r, mine, b, count(*) AS n FROM features JOIN known USING (g) GROUP BY ALL
), sums AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE mine), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT mine), 0)::DOUBLE AS t FROM counted GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM sums) + {BUCKETS}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM sums) + {BUCKETS})))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gain USING (b) WHERE mine GROUP BY r
), scored AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM lists LEFT JOIN weights USING (r) WHERE mine
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS}) * {DRAWN_PERCENT} // 100 THEN place END AS "rank" FROM placed
"""
