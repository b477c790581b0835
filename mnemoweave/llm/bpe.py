"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into the words of the byte-level pre-tokenizer with numpy.  A task gathers its texts into blocks; a block
keeps its distinct words and, for each text, the numbers of its words.  A block deals its distinct words to buckets by
their hash, one packed row for each bucket; what all blocks have in one bucket meets, each word is encoded once by the
tokenizer, and one packed row of ids for each block and bucket goes back to the block, where ids are joined to the texts
by position.  Decoding joins ids to their pieces (one row for each id of the vocabulary) and puts the pieces' bytes
together.  No occurrence of a word is ever shuffled on its own, and a block sends each of its words once.

Blocks are cut from the scan twice, so the input must come in the same rows for each partition both times: documents read
from files do, anything else is written to the checkpoint folder first (``from_files=False``).  A checksum of a block's
words travels with them and is compared when its parts meet; a difference fails the job instead of giving wrong ids.

A null text is an empty one: no ids, an empty decoded text.  Repeated rows give repeated results.  Columns other than
doc_id and text are not read and not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.llm.common import materialise, released, table

#: Characters of a block: bounds what one group of the last step holds (about 20 bytes of memory for each).
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 1_000_000
#: Buckets of words for each shuffle partition, and words whose ids a task keeps at once; of more some are encoded again.
BUCKETS_EACH = 4
KEPT_WORDS = 1_000_000
ENCODED_AT_ONCE = 2000
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_SEPARATOR = b"\xff"  # in no UTF-8 text
_TAILS = ("s", "t", "m", "d", "re", "ve", "ll")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point; one past the last is the end of a text."""
    first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kinds = np.array([_LETTER if c == "L" else _NUMBER if c == "N" else _OTHER for c in first] + [_END], dtype=np.uint8)
    kinds[list(_SPACES)] = _SPACE
    return kinds


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in order, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    code[ends] = 0x110000
    kind = _kinds()[code]
    around = np.full(len(kind) + 2, _END, np.uint8)  # bytes like the kinds, of which numpy compares many at a time
    around[1:-1] = kind
    before, after = around[:-2], around[2:]
    space, end = kind == _SPACE, kind == _END
    blank_before = np.zeros(len(kind), bool)
    blank_before[1:] = code[:-1] == 0x20
    # of a run of spaces the last stands by itself, or before the next word if it is a blank
    space_ends, space_before = ~(np.append(space[1:], False) | np.append(end[1:], True)), before == _SPACE
    start = (space & (~space_before | space_ends)) | (~space & (kind != before) & ~(space_before & blank_before)) | end
    for i in np.flatnonzero((code == 0x27) & start & (after == _LETTER)):
        for tail in _TAILS:
            if joined.startswith(tail, i + 1):
                start[i + 1] = False
                if kind[i + 1 + len(tail)] == _LETTER:
                    start[i + 1 + len(tail)] = True
                for j in range(i + 2, i + 1 + len(tail)):
                    start[j] = False
                break
    at = np.flatnonzero(start)
    real = kind[at] != _END
    stop = np.append(at[1:], len(code))
    words = [joined[a:b] for a, b in zip(at[real].tolist(), stop[real].tolist())]
    count = np.diff(np.searchsorted(at[real], ends), prepend=0)
    return words, count


def split_around(text: str, special: tuple[str, ...]) -> list[str]:
    """The text cut before and after every special token, of which the earliest, then the longest, comes first."""
    out, at = [], 0
    while special:
        found = min(((text.find(s, at), -len(s), s) for s in special if s in text[at:]), default=None)
        if found is None:
            break
        out += [text[at : found[0]], found[2]]
        at = found[0] + len(found[2])
    return [*out, text[at:]]


class _Block:
    """The distinct words of a run of texts, and unless ``words_only`` the numbers of each text's words, packed chunk by
    chunk: (ids of the texts, words of each text, numbers of all their words)."""

    def __init__(self, special: tuple[str, ...], words_only: bool = False):
        self.special, self.words_only = special, words_only
        self.words, self.parts, self.chars = defaultdict(count().__next__), [], 0  # words by number, in order of their first place

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))

    def add(self, ids: list, texts: list[str]) -> None:
        pieces, piece_of = [], []
        for k, text in enumerate(texts):
            cut = split_around(text, self.special) if any(s in text for s in self.special) else [text]
            pieces += cut
            piece_of += [k] * len(cut)
        words, each = split_words([p if p not in self.special else "" for p in pieces])
        self.chars += sum(map(len, texts))
        marks = [i for i, p in enumerate(pieces) if p in self.special]
        if self.words_only:
            self.words.update(dict.fromkeys([*words, *(pieces[i] for i in marks)]))
            self.parts.append(None)
            return
        seq, marked = self._numbers(words), self._numbers([pieces[i] for i in marks])
        if marks:
            before = np.concatenate([[0], np.cumsum(each)])
            seq = np.insert(seq, before[marks], marked)
            each[marks] = 1
        self.parts.append((ids, _packed(np.bincount(piece_of, weights=each, minlength=len(texts))), _packed(seq)))

    def octets(self) -> list[bytes]:
        return [w.encode("utf-8", "surrogatepass") for w in self.words]

    def check(self) -> int:
        return xxhash.xxh64_intdigest("\0".join(self.words).encode("utf-8", "surrogatepass")) >> 1


def _blocks(batches: Iterator[pa.RecordBatch], special: tuple[str, ...], words_only: bool = False) -> Iterator[tuple[int, _Block]]:
    first = TaskContext.get().partitionId() << 32  # more blocks than a partition can have
    block, n = _Block(special, words_only), 0
    ids, texts, waiting = [], [], 0

    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            waiting += len(texts[-1])
            if waiting >= CHUNK_CHARS:
                block.add(ids, texts)
                ids, texts, waiting = [], [], 0
                if block.chars >= BLOCK_CHARS:
                    yield first + n, block
                    block, n = _Block(special, words_only), n + 1
    if texts:
        block.add(ids, texts)
    if block.parts:
        yield first + n, block


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _dealt(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each word, an order that brings them together, and where in it each bucket begins and the last ends."""
    dealt = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
    return dealt, np.argsort(dealt, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(dealt, minlength=buckets))])


def _packed(numbers: np.ndarray) -> bytes:
    return _squeezed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(_spread(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(tokenizer_json: str) -> tuple[list[bytes], tuple[str, ...]]:
    """The bytes of every id, and the texts of the added tokens."""
    spec = json.loads(tokenizer_json)
    stand_in = _byte_of_char()
    added = {t["id"]: t["content"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *added]))
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(stand_in[c] for c in piece) if all(c in stand_in for c in piece) else piece.encode()
    for i, content in added.items():
        out[i] = content.encode()
    return out, tuple(sorted(added.values()))


def encode_decode(docs: DataFrame, tokenizer: str | None = None, *, ids: bool = False, from_files: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and token_ids array<int> if ``ids``, for each row."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    piece_table, special = pieces(spec)
    shared = spark.sparkContext.broadcast((spec, piece_table))  # one row for each id of the vocabulary file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not from_files:
        rows = materialise(rows)

    narrow = "<u2" if len(piece_table) <= 1 << 16 else "<u4"
    buckets = BUCKETS_EACH * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, special, words_only=True):
            found, check = block.octets(), block.check()
            order, cuts = _dealt(found, buckets)[1:]
            some = np.flatnonzero(np.diff(cuts))
            blobs = [_squeezed(_SEPARATOR.join([found[i] for i in order[cuts[k] : cuts[k + 1]]])) for k in some.tolist()]
            cols = [pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([check] * len(some), pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "check", "words"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, special):
            check = block.check()
            dealt = _packed(_dealt(block.octets(), buckets)[0])
            for k, (docs, sizes, numbers) in enumerate(block.parts):  # a row each, of a few hundred kilobytes
                cols = [pa.array([number]), pa.array([check]), pa.array([docs], pa.list_(pa.int64()))]
                cols += [pa.array([x], pa.binary()) for x in (sizes, numbers, None if k else dealt)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "check", "docs", "sizes", "numbers", "buckets"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(shared.value[0])
        model.no_padding()
        model.no_truncation()
        known: dict[bytes, bytes] = {}
        bucket, width = None, np.dtype(narrow).itemsize
        for b in batches:
            sizes, ids = [], []
            for k, blob in zip(b.column(0).to_pylist(), b.column(3)):
                if k != bucket or len(known) > KEPT_WORDS:
                    bucket, known = k, {}
                found = _spread(blob.as_py()).split(_SEPARATOR)
                new = [w for w in found if w not in known]
                for at in range(0, len(new), ENCODED_AT_ONCE):
                    part = new[at : at + ENCODED_AT_ONCE]
                    for w, e in zip(part, model.encode_batch([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)):
                        known[w] = np.array(e.ids, dtype=narrow).tobytes()
                coded = [known[w] for w in found]
                sizes.append(_packed(np.array([len(c) // width for c in coded])))
                ids.append(_packed(np.frombuffer(b"".join(coded), narrow)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "check", "bucket", "sizes", "ids"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        piece_of = shared.value[1]
        by = np.argsort(left["bucket"].to_numpy()).tolist()
        size = np.concatenate([_unpacked(left["sizes"][i].as_py()) for i in by] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([_unpacked(left["ids"][i].as_py()) for i in by] or [np.zeros(0, np.uint32)])
        ends = np.cumsum(size)
        numbered, spans = flat.tolist(), list(zip((ends - size).tolist(), ends.tolist()))
        listed = [",".join(map(str, numbered[s:e])).encode() for s, e in spans]
        spelled = [b"".join([piece_of[i] for i in numbered[s:e]]) for s, e in spans]
        coded = [flat[s:e].astype(narrow).tobytes() for s, e in spans] if ids else []
        dealt = next(_unpacked(x.as_py()) for x in right["buckets"] if x.is_valid)
        place = np.empty(len(dealt), np.int64)  # of a word of the block among those that come back
        place[np.argsort(dealt, kind="stable")] = np.arange(len(dealt))
        checks = {*left["check"].to_pylist(), *right["check"].to_pylist()}
        if len(checks) > 1 or len(place) != len(size):
            raise RuntimeError("the words of a block and its texts come from different rows; give from_files=False")
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"token_ids": []} if ids else {})
        spell, listing = spelled.__getitem__, listed.__getitem__
        for r in range(right.num_rows):
            numbers, at = place[_unpacked(right["numbers"][r].as_py())], 0
            for doc, n in zip(right["docs"][r].as_py(), _unpacked(right["sizes"][r].as_py()).tolist()):
                part = numbers[at : at + n]
                mine = part.tolist()
                at += n
                raw = b"".join(map(spell, mine))
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", "replace").encode()
                out["doc_id"].append(doc)
                out["n_tokens"].append(int(size[part].sum()))
                out["ids_sha256"].append(hashlib.sha256(b",".join(map(listing, mine))).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                if ids:
                    out["token_ids"].append(np.frombuffer(b"".join([coded[i] for i in mine]), narrow).astype(np.int32))
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "token_ids": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    table_of_words = rows.mapInArrow(released(words), "bucket int, block long, check long, words binary").repartition("bucket").sortWithinPartitions("bucket")
    coded = table_of_words.mapInArrow(released(encode), "block long, check long, bucket int, sizes binary, ids binary")
    by_block = rows.mapInArrow(released(texts), "block long, check long, docs array<long>, sizes binary, numbers binary, buckets binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return coded.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(join, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
