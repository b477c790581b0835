"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits.  Two that differ in at most 3 bits differ in at most 1 bit of one 32-bit half, so each half is
covered by itself: the anchors of a half are the words of Hamming(31, 26) with the last bit free, a code of covering
radius 1.  A fingerprint is at home at the anchor nearest to its half and is replicated to every anchor within covering
radius plus threshold (1 + 1) of it, 17 at most.  A pair meets at the home of either, so comparing home rows with all
rows of an anchor finds every link.  Only distinct fingerprints are replicated; per anchor a spanning forest of the
links is emitted instead of all pairs, which keeps every component whole.

Nulls and texts without a word have fingerprint zero and are linked like any other.  Repeated rows come out repeated.
A null doc_id belongs to the component of its fingerprint and is never its smallest id.

The pipeline stage takes the same covering of SimHashes over five-word shingles: texts whose fingerprints differ in at
most 3 bits meet at their anchors.  Most texts of a Jaccard similarity near 0.8 differ in more bits, so minima of the
shingles' hashes bring the rest together.  Of either kind only those whose sets have a Jaccard similarity of 0.8 or more are linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from mnemoweave.llm.common import connected_components, hot_keys_split, majority_bits, materialise, released, runs, stored, table

THRESHOLD = 3
CODE_BITS = 31
#: Rows of an anchor compared in one task at once; larger anchors are cut into pieces and compared piece by piece.
ANCHOR_ROWS = 1024
#: The pipeline stage: words a shingle, least Jaccard similarity of the sets, keys of so many minima each.
SHINGLE_WORDS, LEAST_JACCARD, BANDS, BAND_MINIMA = 5, 0.8, 24, 5
_FACTORS = np.random.default_rng(20240302).integers(0, 1 << 31, BANDS * BAND_MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints_of(texts: list[str | None], width: int = 3, seed: int = 42, flush: int = 1 << 18) -> np.ndarray:
    """64-bit SimHash of lower-cased word shingles, repeats included; fewer words than ``width`` make one shingle."""
    out, hashes, lengths = [], [], []
    digest = xxhash.xxh64_intdigest
    waiting = 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(words) >= width:
            got = [digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(width)))]
        else:
            got = [digest(b" ".join(words), seed)] if words else []
        hashes.append(np.array(got, dtype=np.uint64))
        lengths.append(len(got))
        waiting += len(got)
        if waiting > flush:
            out.append(majority_bits(np.concatenate(hashes), np.array(lengths)))
            hashes, lengths, waiting = [], [], 0
    if lengths:
        out.append(majority_bits(np.concatenate(hashes), np.array(lengths)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = fingerprints_of(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(compute, "doc_id long, fp long")


def anchors(fp: Column) -> Column:
    """array<struct<anchor long, home boolean>>: the anchors of both halves within covering radius plus threshold."""
    out = []
    for half in (0, 1):
        word = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))
        y = word.bitwiseAND(F.lit(0x7FFFFFFF))
        top = F.shiftrightunsigned(word, CODE_BITS)
        syndrome = F.lit(0)
        for k in range(5):  # bit k of the xor of the positions 1..31 that are set
            mask = sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1)
            syndrome = syndrome + F.bit_count(y.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
        out.append(F.struct(F.lit(half).cast("long").alias("half"), y.alias("y"), top.alias("top"), syndrome.cast("int").alias("s")))

    def of(h: Column) -> Column:
        bit = lambda p: F.when(p == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), p - 1))
        home = h["y"].bitwiseXOR(bit(h["s"]))
        key = lambda c, t: F.call_function("shiftleft", h["half"], F.lit(32)).bitwiseOR(F.call_function("shiftleft", t, F.lit(31))).bitwiseOR(c)
        far = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(CODE_BITS)), lambda j: (h["s"] > 0) & (j < j.bitwiseXOR(h["s"]))),
            lambda j: F.struct(key(h["y"].bitwiseXOR(bit(j)).bitwiseXOR(bit(j.bitwiseXOR(h["s"]))), h["top"]).alias("anchor"), F.lit(False).alias("home")),
        )
        near = F.array(
            F.struct(key(home, h["top"]).alias("anchor"), F.lit(True).alias("home")),
            F.struct(key(home, F.lit(1).cast("long") - h["top"]).alias("anchor"), F.lit(False).alias("home")),
        )
        return F.concat(near, far)

    return F.flatten(F.transform(F.array(*out), of))


def spanning_links(fp: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the graph on ``fp`` in which ``may(i, others)`` tells i's neighbours."""
    left = np.arange(len(fp))
    found: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = may(i, left)
            if hit.any():
                found += [(i, int(j)) for j in left[hit]]
                queue += [int(j) for j in left[hit]]
                left = left[~hit]
        queue = []
    return found


def _links(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    return spanning_links(fp, lambda i, o: (np.bitwise_count(fp[o] ^ fp[i]) <= THRESHOLD) & (home[o] | home[i]))


def _short_and_long(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return at, np.append(at[1:], len(key))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp, home) sorted by anchor to links (a, b), or for an anchor of too many rows to its own rows."""
    for whole, (anchor, fp, home) in runs(batches, 1, ANCHOR_ROWS):
        fp = fp.view(np.uint64)
        home = home.astype(bool)
        if not whole:
            yield _batch(anchor, fp.view(np.int64), home, True)
            continue
        at, ends = _short_and_long(anchor)
        size = ends - at
        a, b = [], []
        for i in np.flatnonzero(size > 16):
            s = slice(at[i], ends[i])
            for x, y in _links(fp[s], home[s]):
                a.append(fp[s][x : x + 1])
                b.append(fp[s][y : y + 1])
        for d in range(1, int(min(16, size.max()))):  # the d-th next row of the same short run
            left = np.repeat(np.where(size <= 16, ends, 0), size) - np.arange(len(fp))
            i = np.flatnonzero(left > d)
            i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= THRESHOLD) & (home[i] | home[i + d])]
            a.append(fp[i])
            b.append(fp[i + d])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield _batch(a.view(np.int64), b.view(np.int64), np.ones(len(a), bool), False)


def _batch(a: np.ndarray, b: np.ndarray, home: np.ndarray, hot: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(home), pa.array(np.full(len(a), hot))], names=["a", "b", "home", "hot"])


def _compare_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (anchor, i, j, fp, home) in runs(batches, 3, 1 << 62):
        fp, home = fp.view(np.uint64), home.astype(bool)
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for s, e in zip(cut, np.append(cut[1:], len(fp))):
            if found := _links(fp[s:e], home[s:e]):
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[s:e][x].view(np.int64)), pa.array(fp[s:e][y].view(np.int64))], names=["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that span every component of Hamming distance 3."""
    rows = distinct.select("fp", F.explode(anchors(F.col("fp"))).alias("x")).select("x.anchor", "fp", "x.home")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    found = materialise(rows.mapInArrow(_compare, "a long, b long, home boolean, hot boolean"))
    hot = hot_keys_split(found.where("hot").select(F.col("a").alias("anchor"), F.col("b").alias("fp"), "home"), "anchor", "fp", ANCHOR_ROWS)
    hot = hot.select("anchor", "_i", "_j", "fp", "home").repartition("anchor", "_i", "_j").sortWithinPartitions("anchor", "_i", "_j")
    return found.where("not hot").select("a", "b").unionByName(hot.mapInArrow(_compare_pieces, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: component_id is the smallest doc_id linked, itself included."""
    marked = stored(fingerprints(docs, width))
    per_fp = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(fingerprint_links(per_fp))
    grouped = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, h1, size) sorted by key, those with another member of a size near enough, under one name for each set."""
    for whole, (key, h1, size) in runs(batches, 1, ANCHOR_ROWS):
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h1)], names=["key", "h1"])
            continue
        order = np.lexsort((h1, size, key))
        key, h1, size = key[order], h1[order], size[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])])
        key, h1, size = key[new], h1[new], size[new]
        near = (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= (1 - LEAST_JACCARD) * size[1:] + 1e-9)
        hit = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        key, h1 = key[hit], h1[hit]
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            h = h1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
            name = np.repeat(np.add.reduceat(h ^ h >> np.uint64(29), at).view(np.int64), np.diff(np.append(at, len(key))))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(h1)], names=["key", "h1"])


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than a shingle make one."""
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    rolling = zip(*(words[i:] for i in range(SHINGLE_WORDS)))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(x)) for x in rolling), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of ``BAND_MINIMA`` minima each: two sets of Jaccard 0.8 share none in less than 1 of 10,000 cases."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    g = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.empty(len(_FACTORS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        mixed = (g ^ factor) * factor
        low[k] = (mixed ^ mixed >> np.uint32(15)).min()
    x = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_MINIMA):
        x = (x ^ low[k::BAND_MINIMA]) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, h1, size, fp, keys): a digest of the words, how many shingles, their SimHash, the band keys."""
    for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        h1, sets, keys = [], [], []
        for i in range(b.num_rows):
            words = _words(b.column(1)[i].as_py())
            sets.append(shingle_set(words))
            h1.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            keys.append(band_keys(sets[-1]))
        size = np.array([len(x) for x in sets])
        fp = majority_bits(np.concatenate(sets), size).view(np.int64)
        cols = [b.column(0), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h1", "size", "fp", "keys"])


def _near_at_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, fp, home) sorted by anchor, (anchor, fp) of those near another; all of an anchor of too many rows.

    Unlike in ``_compare`` no forest of links is made: the sets of two texts decide on each link by itself.
    """
    for whole, (anchor, fp, home) in runs(batches, 1, ANCHOR_ROWS):
        if whole:
            fp, home = fp.view(np.uint64), home.astype(bool)
            at, ends = _short_and_long(anchor)
            last, near, i = np.repeat(ends, ends - at), np.zeros(len(fp), bool), np.arange(len(fp))
            for d in range(1, int((ends - at).max())):  # the d-th next row of the same anchor
                i = i[i + d < last[i]]
                hit = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= THRESHOLD) & (home[i] | home[i + d])]
                near[hit] = near[hit + d] = True
            anchor, fp = anchor[near], fp[near].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp)], names=["key", "fp"])


def close_fingerprints(distinct: DataFrame) -> DataFrame:
    """(key, fp): any two of the distinct fingerprints of column ``fp`` that differ in at most 3 bits share a key, an anchor."""
    rows = distinct.select("fp", F.explode(anchors(F.col("fp"))).alias("x")).select("x.anchor", "fp", "x.home")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(_near_at_anchors), "key long, fp long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (h1, shingles)."""
    for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        h1, found = [], []
        for i in range(b.num_rows):
            words = _words(b.column(0)[i].as_py())
            h1.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            found.append(shingle_set(words).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(found, pa.binary())], names=["h1", "shingles"])


def _similar_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between rows (key, _i, _j, h1, shingles) sorted by the first three whose sets are similar enough."""
    for _, (key, i, j, h1, raw) in runs(batches, 3, 1 << 62):
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for s, e in zip(cut, np.append(cut[1:], len(key))):
            sets = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
            size = np.array([len(x) for x in sets])

            def may(k: int, others: np.ndarray, sets=sets, size=size) -> np.ndarray:
                near = np.minimum(size[others], size[k]) >= LEAST_JACCARD * np.maximum(size[others], size[k])
                for o in np.flatnonzero(near):
                    both = len(np.intersect1d(sets[k], sets[others[o]], assume_unique=True))
                    near[o] = both >= LEAST_JACCARD * (size[k] + size[others[o]] - both) - 1e-9
                return near

            if found := spanning_links(np.arange(e - s), may):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(h1[s:e][a]), pa.array(h1[s:e][b])], names=["a", "b"])


def _named(rows: DataFrame) -> DataFrame:
    """The rows, of which column ``text`` is a string, and h1, a digest of the text's words."""

    at = rows.columns.index("text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            h1 = [xxhash.xxh3_64_intdigest(b" ".join(_words(x.as_py()))) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(h1, np.uint64).view(np.int64))], names=[*b.schema.names, "h1"])

    return rows.mapInArrow(released(digest), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "h1 long"]))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, component_id, leads) for each row: texts linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    Sets whose SimHashes differ in at most 3 bits, or that share a band key, are compared in full before they are linked;
    texts without a word are alike.  h1 is a digest
    of the text's words, component_id the smallest doc_id; ``leads`` marks the smallest (doc_id, h1) of a component.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stored(rows.mapInArrow(released(_sketches), "doc_id long, h1 long, size int, fp long, keys array<long>"))
    per_text = stored(marked.groupBy("h1").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    texts = per_text.where("size > 0")
    # an anchor, and a fingerprint of several texts, is a key that brings its texts together like a band key
    met = close_fingerprints(texts.select("fp").distinct()).select(F.xxhash64("key", F.lit(1)).alias("key"), "fp")
    met = met.unionByName(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("fp", F.lit(0)).alias("key"), "fp"))
    keys = per_text.select(F.explode("keys").alias("key"), "h1", "size").unionByName(met.join(texts, "fp").select("key", "h1", "size"))
    keys = keys.repartition("key").sortWithinPartitions("key")
    shared = stored(keys.mapInArrow(released(sharing), "key long, h1 long").distinct())
    sets = rows.select("text").mapInArrow(released(_sets), "h1 long, shingles binary").join(shared.select("h1").distinct(), "h1", "left_semi").groupBy("h1").agg(F.first("shingles").alias("shingles"))
    groups = hot_keys_split(shared, "key", "h1", ANCHOR_ROWS).join(sets, "h1").select("key", "_i", "_j", "h1", "shingles")
    links = groups.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(released(_similar_sets), "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "h1")
    grouped = per_text.join(roots, "h1", "left").select("h1", "low", F.coalesce("root", "h1").alias("root"))
    lows = grouped.groupBy("root").agg(F.min(F.struct(F.col("low").alias("doc_id"), "h1")).alias("lead"))
    named = grouped.join(lows, "root").select("h1", "lead")
    leads = F.struct("doc_id", "h1") == F.col("lead")
    return marked.select("doc_id", "h1").join(named, "h1").select("doc_id", "h1", F.col("lead.doc_id").alias("component_id"), leads.alias("leads"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, columns as they are.

    Of rows equal in doc_id and words one stays, the smallest in the order of the columns; different texts of one doc_id
    are judged each by itself, and of those in one component the one whose words have the smallest digest stays.  Rows with
    a null doc_id take no part and are kept.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)  # no name of a column can clash
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = numbered.where(key.isNotNull()).select(*names, key.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    lead = near_copies(rows).where("leads").select("doc_id", "h1").distinct()
    kept = _named(rows).join(lead, ["doc_id", "h1"], "left_semi").groupBy("doc_id", "h1")
    whole = F.struct(*names)
    kept = kept.agg((F.first(whole) if any(isinstance(f.dataType, MapType) for f in docs.schema.fields) else F.min(whole)).alias("row")).select("row.*")
    return kept.unionByName(numbered.where(key.isNull())).toDF(*docs.columns)
