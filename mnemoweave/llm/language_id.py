"""Language identification by compression with per-language zstandard raw-content dictionaries.

A text is reduced to its distinct lower-cased words in order of first occurrence, padded so that even a text of a few
words is worth compressing (else frames hold it as it is, all of one size), then compressed once with each language's
dictionary; the smallest frame names the language.  The margin between the two smallest frames, as a share
of the second, is the confidence; margins under ``NARROW`` are rejections.

Dictionaries are cut from whole texts of labelled rows: at most ``SAMPLE_ROWS`` rows for each language, the first in a
fixed pseudo-random order, those of ``SAMPLE_CHARS`` characters before others, until ``DICTIONARY_BYTES`` are full.  Rows are
drawn by a hash threshold set from each language's count, so that what meets in one task stays bounded at any size.  That
sample is the only bound; every text is read whole.  Repeats of a word within a text are left out before compression: they
compress to next to nothing under any dictionary, and sizes of long texts would drown the difference between dictionaries.

A null text, or one without a letter, is ``und`` with score 0, as is every text when no language could be learned.
Ties go to the language that sorts first, with score 0.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import fold_of, released, sample_order, table

SAMPLE_ROWS = 400
SAMPLE_CHARS = (200, 4000)
DRAWN = 8  # times SAMPLE_ROWS, before the first in order are taken
DICTIONARY_BYTES = 65536
MODEL_BYTES = 32 << 20  # what all dictionaries have together; of very many languages each gets less
LEVEL = 6
PADDING = b"\n" * 64
NARROW = 0.003
#: A margin at which the score is one half.
HALF_SCORE_MARGIN = 0.03
UNDETERMINED = "und"
_LETTERS = bytes.maketrans(
    bytes(range(65, 91)) + bytes(i for i in range(128) if not chr(i).isalpha()),
    bytes(range(97, 123)) + b" " * sum(not chr(i).isalpha() for i in range(128)),
)


def distinct_words(text: str | None) -> bytes:
    return b" ".join(dict.fromkeys((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()))


def learn(docs: DataFrame, may_learn: Column) -> dict[str, bytes]:
    """language -> raw dictionary content, from the rows of (doc_id, text, lang) where ``may_learn`` holds."""
    low, high = SAMPLE_CHARS
    usual = F.length("text").between(low, high)
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count_if(usual).alias("usual"), F.count_if(~usual).alias("other")).collect()
    if not counts:
        return {}
    room = min(DICTIONARY_BYTES, MODEL_BYTES // len(counts))
    rate = lambda n: min(1.0, DRAWN * SAMPLE_ROWS / n) if n else 0.0
    rates = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], F.array(F.lit(rate(r["usual"])), F.lit(rate(r["other"]) if r["usual"] < SAMPLE_ROWS else 0.0)))))[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.when(usual, rates[0]).otherwise(rates[1]) * (1 << 20)
    order = Window.partitionBy("lang").orderBy(F.when(usual, 0).otherwise(1), *sample_order("doc_id"), "text")
    rows = labelled.where(drawn).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS)
    found: dict[str, bytes] = {}
    for r in rows.orderBy("lang", "_n").select("lang", "text").toLocalIterator():
        if len(have := found.get(r["lang"], b"")) < room and (words := distinct_words(r["text"])):
            found[r["lang"]] = have + words + b" "
    return {lang: content[:room] for lang, content in found.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin)."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        words = distinct_words(text) + PADDING
        sizes = sorted((len(c.compress(words)), i) for i, c in enumerate(self.compressors))
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return self.languages[sizes[0][1]], margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *carry: str) -> DataFrame:
    """The columns ``carry`` of each row, whatever their names, then lang_pred, margin (0 to 1) and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # MODEL_BYTES at most
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), F.col("text").cast("string")).toDF(*names, "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for b in batches:
            got = [model(x.as_py()) for x in b.column(len(names))]
            scores = [g[1] / (g[1] + HALF_SCORE_MARGIN) for g in got]
            cols = [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "margin", "score"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "margin double", "score double"])
    return rows.mapInArrow(released(predict), fields).toDF(*carry, "lang_pred", "margin", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 3)
    found = classify(docs, learn(docs, fold != 1), "doc_id")
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", (F.col("margin") < NARROW).alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a margin of at least ``NARROW``; columns as they are."""
    dictionaries = learn(docs, fold_of("doc_id", 3) != 1)
    judged = classify(docs, dictionaries, *docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = judged.toDF(*names, "lang_pred", "margin", "score")  # columns of docs may have these names
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("margin") >= NARROW))
    return kept.select(*names).toDF(*docs.columns)
