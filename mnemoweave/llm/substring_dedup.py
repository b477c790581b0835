"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position depends on the 16 bytes before it alone; a cut is made where its five top bits are zero and
a character ends, so the cuts inside a passage come out the same wherever the passage stands, and an insertion moves
only the cuts next to it.  What is compared, by 128-bit digests, are pieces: every two chunks that follow each other,
every chunk of ``LEAST_BYTES`` or more, and a text's only chunk.  A piece that stands at more than one place is a repeat;
its first place, the smallest (doc_id, start), is the one that stays.

Each place of a repeated piece is paired with the first place (the first with the last), and with the place before it in
the same text if there is one.  Pieces of a text that are paired with places the same distance away and touch make one
span, so a span stands whole at its other place.  Spans of ``LEAST_BYTES`` or more are reported, which leaves out
single boilerplate lines and chance repeats of a few words; of spans to remove, and of the others, those inside another
of the same text are left out.  Spans with different other places may overlap.

Texts are compared by their UTF-8 bytes, whole.  Null texts, empty texts and null doc_ids take part in nothing; a row that
repeats counts once; of rows of one doc_id whose texts differ each is a text of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import stored, table

CUT_BITS = 5  # a cut at one position in 32
LEAST_BYTES = 80
HOT_SHARE = 1000
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
_FLUSH_BYTES = 4_000_000


def cut_after(octets: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash cuts."""
    h = _GEAR[octets]
    for width in (1, 2, 4, 8):  # the sum of shifted gears over 2 * width bytes
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    at = np.flatnonzero(h >> np.uint16(16 - CUT_BITS) == 0)
    return at[(octets[np.minimum(at + 1, len(octets) - 1)] & 0xC0) != 0x80] if len(octets) else at


def chunks_of(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of every chunk."""
    if not raw:
        return []
    at = cut_after(np.frombuffer(raw, np.uint8)) + 1
    edges = [0, *at[at < len(raw)].tolist(), len(raw)]
    return list(zip(edges, edges[1:]))


def pieces_of(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of every piece that is compared, in order of start."""
    found = chunks_of(raw)
    if len(found) < 2:
        return found
    pairs = [(s, e) for (s, _), (_, e) in zip(found, found[1:])]
    return sorted(pairs + [(s, e) for s, e in found if e - s >= LEAST_BYTES])


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, size, d1, d2): the pieces of every text, a hash of it, and the halves of their digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, whole = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for b in batches:
            ids, versions, starts, sizes, digests, waiting = [], [], [], [], [], 0
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                found = pieces_of(raw)
                ids.append((b.column(0)[i].as_py(), len(found)))
                versions.append(whole(raw))
                starts += [s for s, _ in found]
                sizes += [e - s for s, e in found]
                digests += [digest(raw[s:e]) for s, e in found]
                waiting += len(raw)
                if waiting >= _FLUSH_BYTES or i == b.num_rows - 1:
                    if digests:
                        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                        doc = np.repeat(np.array([x for x, _ in ids]), [n for _, n in ids])
                        version = np.repeat(np.array(versions, np.uint64).view(np.int64), [n for _, n in ids])
                        cols = [pa.array(doc), pa.array(version), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "version", "start", "size", "d1", "d2"])
                    ids, versions, starts, sizes, digests, waiting = [], [], [], [], [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null and text <> ''").mapInArrow(cut, "doc_id long, version long, start int, size int, d1 long, d2 long")


def repeated_pieces(found: DataFrame) -> DataFrame:
    """``found`` at the places of pieces that repeat, with the first and last place (doc_id, version, start) of each.

    A digest that holds over a ``HOT_SHARE``-th of these places is joined without a shuffle: there are fewer than
    ``HOT_SHARE`` of them, whatever the size of the table.  The others are shuffled on their own.
    """
    place = F.struct("doc_id", "version", "start")
    shared = found.groupBy("d1", "d2").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.where("low <> high"))
    most = (shared.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot, rest = (shared.where(F.col("n") > most).drop("n"), shared.where(F.col("n") <= most).drop("n"))
    at_hot = found.join(F.broadcast(hot), ["d1", "d2"])
    at_rest = found.join(F.broadcast(hot.select("d1", "d2")), ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"])
    return at_hot.unionByName(at_rest)


def repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Passages that stand at more than one place.

    (doc_id, start_byte, end_byte, first_doc_id, other_doc_id, other_start_byte, removable_bytes): the same bytes stand in
    other_doc_id from other_start_byte on; first_doc_id is the smaller of the two documents; removable_bytes is the
    passage's length if the other place comes first, else 0.
    """
    hit = repeated_pieces(pieces(docs)).repartition("doc_id", "version").dropDuplicates(["doc_id", "version", "start", "size"])
    own = F.struct("doc_id", "version", "start")
    before = F.lag("start").over(Window.partitionBy("doc_id", "version", "d1", "d2").orderBy("start"))
    inside = F.when(before.isNotNull(), F.struct("doc_id", "version", before.alias("start")))
    far = F.when(F.col("low") == own, F.col("high")).otherwise(F.col("low"))
    hit = hit.select("doc_id", "version", "start", "size", far.alias("far"), inside.alias("inside"))
    hit = hit.select("doc_id", "version", "start", "size", F.explode(F.array_distinct(F.array_compact(F.array("far", "inside")))).alias("at"))
    hit = hit.select("doc_id", "version", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"), F.col("at.doc_id").alias("o_doc"), F.col("at.version").alias("o_version"), (F.col("at.start") - F.col("start")).alias("away"))

    key = ["doc_id", "version", "o_doc", "o_version", "away"]
    order = Window.partitionBy(*key).orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hit.withColumn("new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy(*key, "span").agg(F.min("s").alias("start_byte"), F.max("e").alias("end_byte")).where(F.col("end_byte") - F.col("start_byte") >= least_bytes)

    other = F.col("start_byte") + F.col("away")
    later = F.struct("o_doc", "o_version", other.alias("at")) < F.struct("doc_id", "version", F.col("start_byte").alias("at"))
    spans = spans.withColumns({"later": later, "o_start": other})
    outer = Window.partitionBy("doc_id", "version", "later").orderBy("start_byte", F.desc("end_byte"), "o_doc", "o_version", "away")
    covered = F.max("end_byte").over(outer.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("covered", covered).where("covered is null or covered < end_byte")
    return spans.select(
        "doc_id",
        "start_byte",
        "end_byte",
        F.least("doc_id", "o_doc").alias("first_doc_id"),
        F.col("o_doc").alias("other_doc_id"),
        F.col("o_start").alias("other_start_byte"),
        F.when(F.col("later"), F.col("end_byte") - F.col("start_byte")).otherwise(0).alias("removable_bytes"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
