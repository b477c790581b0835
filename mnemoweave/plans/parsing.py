"""Structural parsing: documents to raw chunks, by built-in expressions but for the overlapping sentence split.

Each form marks its borders in the text with control characters, splits there and explodes; nothing is shuffled but the
carried section names of transcripts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import day_in_text, day_seconds, token_estimate

MOST_TOKENS = 800
OVERLAP_TOKENS = 100
PREAMBLE_TOKENS = 10
SPLIT_ROWS = 256
_CUT, _HEAD = "\x01", "\x02"

#: The line patterns that tell the forms apart.
SPEAKER = r"(?mdU)^\*\*([^*:]+?):\*\*\s*|^\*\*([^*]+?)\*\*:\s*|^(Speaker\s+\d+):\s*"
HEADER = r"(?mdU)^(#{2,3})\s+(.+)$"
DATE_LINE = r"(?mdU)^(?:#+\s*)?(\d{4}-\d{2}-\d{2}|\w+\s+\d{1,2},?\s+\d{4})$"
PARAGRAPH = r"(?U)\n\s*\n"
SENTENCE = r"(?<=[.!?])\s+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def document_type(text: Column) -> Column:
    """meeting_transcript, date_structured, markdown or plain_text."""
    return (
        F.when(text.rlike(SPEAKER), "meeting_transcript").when(F.regexp_count(text, F.lit(DATE_LINE)) >= 2, "date_structured").when(text.rlike(HEADER), "markdown").otherwise("plain_text")
    )


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH), stripped), lambda p: p != "")


def word_windows(text: Column, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Windows of int(most / 1.3) words that overlap by int(overlap / 1.3)."""
    size = max(int(most / 1.3), 1)
    step = size - min(int(overlap / 1.3), size - 1)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def _tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def split_long(text: str, most: int, overlap: int) -> list[str]:
    """A text over ``most`` estimated tokens in runs of sentences, each run starting with the last sentences of the one
    before that fit ``overlap``; a text of one sentence in windows of words."""
    if _tokens(text) <= most:
        return [text]
    parts = re.split(SENTENCE, text)
    if len(parts) == 1:
        words, size = text.split(), max(int(most / 1.3), 1)
        step = size - min(int(overlap / 1.3), size - 1)
        starts = range(0, max(len(words) - size, 0) + step, step)
        return [" ".join(words[s : s + size]) for s in starts if s == 0 or s + size - step < len(words)]
    sizes = [_tokens(p) for p in parts]
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            out.append(" ".join(parts[start:i]))
            j, total = i, 0
            while j > start and total + sizes[j - 1] <= overlap:
                j -= 1
                total += sizes[j]
            start = j
        total += n
    return [*out, " ".join(parts[start:])]


def long_splitter(most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS):
    """The sentence split as an Arrow UDF: what follows depends on what was carried over, which no expression tells.

    Of a batch only some texts at a time are Python strings.
    """
    kind = pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        some = (texts.slice(k, SPLIT_ROWS).to_pylist() for k in range(0, len(texts), SPLIT_ROWS))
        made = [pa.array([split_long(t, most, overlap) if t is not None else None for t in part], kind) for part in some]
        return pa.concat_arrays(made or [pa.array([], kind)])

    return split


def _split_if_long(text: Column, most: int, overlap: int) -> Column:
    """``split_long`` for texts that may be too long; others do not go to Python.  It counts some control characters as white space, too."""
    short = (token_estimate(text) <= most) & ~text.rlike("[\x1c-\x1f]")
    return F.when(short, F.array(text)).otherwise(long_splitter(most, overlap)(F.when(~short, text)))


def parsed(docs: DataFrame, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Raw chunks of (source_document, text, memory_category) rows; blank and null texts give none."""
    text = F.col("text")
    struct = lambda speaker, section, ts, body, head: F.struct(speaker.alias("speaker"), section.alias("section"), ts.alias("ts"), body.alias("body"), head.alias("is_preamble"))
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("long")
    at = F.col("doc_time")

    def cut(pattern: str, name: str) -> Column:
        return F.split(F.regexp_replace(text, pattern, f"{_CUT}{name}{_HEAD}"), _CUT)

    head = lambda p: F.substring_index(p, _HEAD, 1)
    body = lambda p: stripped(F.when(F.contains(p, F.lit(_HEAD)), F.substring_index(p, _HEAD, -1)).otherwise(p))
    of_turn = lambda p, i: struct(F.when(i > 0, F.trim(head(p))), none, at, body(p), i == 0)
    of_date = lambda p, i: struct(none, F.when(i > 0, head(p)), F.when(i > 0, day_seconds(head(p))).otherwise(day_in_text(p)), body(p), i == 0)
    section = lambda p, i: F.transform(paragraphs(body(p)), lambda q: struct(none, F.when(i > 0, F.trim(head(p))), at, q, F.lit(False)))
    pieces = (
        F.when(F.col("form") == "meeting_transcript", F.transform(cut(SPEAKER, "$1$2$3"), of_turn))
        .when(F.col("form") == "date_structured", F.transform(cut(DATE_LINE, "$1"), of_date))
        .when(F.col("form") == "markdown", F.flatten(F.transform(cut(HEADER, "$2"), section)))
        .otherwise(F.transform(paragraphs(text), lambda q: struct(none, none, at, q, F.lit(False))))
    )
    rows = docs.where(stripped(text) != "").withColumns({"form": document_type(text), "doc_time": F.coalesce(day_in_text(text), no_time)})
    first_header = F.regexp_extract(text, HEADER, 2)
    rows = rows.select("source_document", "memory_category", "form", first_header.alias("first_header"), F.posexplode(pieces).alias("pos", "p"))
    rows = rows.select("source_document", "memory_category", "form", "first_header", "pos", "p.*")
    titles = F.regexp_extract_all("body", F.lit(HEADER), F.lit(2))
    seen = F.last(F.when(~F.col("is_preamble"), F.try_element_at(titles, F.lit(-1))), ignorenulls=True).over(Window.partitionBy("source_document").orderBy("pos"))
    carried = F.coalesce(seen, F.when(F.col("first_header") != "", F.col("first_header")))
    rows = rows.withColumn("section_name", F.trim(F.when(F.col("form") == "meeting_transcript", carried).otherwise(F.col("section"))))
    rows = rows.where((F.col("body") != "") & (~F.col("is_preamble") | (token_estimate(F.col("body")) > PREAMBLE_TOKENS)))
    rows = rows.select("source_document", "memory_category", "pos", "section_name", "speaker", F.col("ts").alias("timestamp"), F.posexplode(F.when(F.col("is_preamble"), F.array("body")).otherwise(_split_if_long(F.col("body"), most, overlap))).alias("part", "text"))
    order = Window.partitionBy("source_document").orderBy("pos", "part")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("pos", "part").select("source_document", "position", "section_name", "speaker", "timestamp", "memory_category", "text")
