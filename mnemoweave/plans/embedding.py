"""Vectors of entities and files, and searches over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import cosine, descriptor, path_stem
from mnemoweave.operators.aggregates import top_neighbours
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise

DIMENSIONS = 384
FILE_WORDS = 300
#: Line beginnings at which source files are cut.
DEFINITIONS = r"^\s*(?:async\s+def |def |class |fn |pub fn |pub struct |struct |impl |func |function |export function |export class |interface )"
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Unit vectors of signed word hashes: the same for the same text everywhere, with no model."""
    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dimensions] += 1 if h >> 63 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).tolist()


def embedded(rows: DataFrame, text: str, embed: Embedder = hashing_embedder) -> DataFrame:
    """``rows`` with ``vector``.  Texts of like length come next to each other, so that batches waste little padding."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        order = texts.fillna("").str.len().argsort(kind="stable")
        found = embed(texts.fillna("").iloc[order].tolist())
        return pd.Series(found, index=texts.index[order]).reindex(texts.index)

    return rows.withColumn("vector", run(text))


def entity_descriptors(state: GraphState) -> DataFrame:
    """(id, text): what each entity is embedded by, with its seven most frequent neighbours."""
    names = state.entities.select(F.col("id").alias("neighbor"), "canonical_name")
    near = top_neighbours(state, 7).join(names, "neighbor").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical_name"))), lambda s: s["canonical_name"]).alias("near"))
    stems = state.entity_documents.select(F.col("entity_id").alias("id"), path_stem(F.col("document")).alias("stem"))
    order = Window.partitionBy("id").orderBy("stem")
    stems = stems.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("id").agg(F.array_sort(F.collect_list("stem")).alias("stems"))
    e = state.entities.select("id", "canonical_name", "entity_type", "aliases").join(near, "id", "left").join(stems, "id", "left")
    return e.select("id", descriptor(F.col("canonical_name"), F.col("entity_type"), F.col("aliases"), F.col("near"), F.col("stems")).alias("text"))


def refreshed(state: GraphState, stored: DataFrame, embed: Embedder = hashing_embedder) -> DataFrame:
    """(entity_id, sha256, vector) of every entity; ``stored`` has earlier ones.

    A vector holds as long as the hash of what its entity is embedded by: entities that are new, renamed or have other
    neighbours are embedded, rows of others are kept, and rows of entities that are gone or have changed drop out.
    """
    now = materialise(entity_descriptors(state).select(F.col("id").alias("entity_id"), "text", F.sha2("text", 256).alias("sha256")))
    kept = stored.join(now.select("entity_id", "sha256"), ["entity_id", "sha256"], "left_semi").select("entity_id", "sha256", "vector")
    missing = now.join(kept.select("entity_id"), "entity_id", "left_anti")
    return kept.unionByName(embedded(missing, "text", embed).select("entity_id", "sha256", "vector"))


def top_similar(vectors: DataFrame, key: str, query: list[float], k: int) -> DataFrame:
    """(key, similarity): the k keys of the highest cosine; a key's best vector counts."""
    q = F.array(*(F.lit(float(x)) for x in query))
    best = vectors.groupBy(key).agg(F.max(cosine(F.col("vector"), q)).alias("similarity"))
    return best.orderBy(F.desc("similarity"), key).limit(k)


def file_pieces(files: DataFrame, most_words: int = FILE_WORDS) -> DataFrame:
    """(path, piece, text): short files whole, longer ones cut before their definitions."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    marked = F.regexp_replace("content", rf"(?m)({DEFINITIONS})", "\x01$1")
    cut = F.filter(F.split(marked, "\x01"), lambda p: F.trim(p) != "")
    return files.select("path", F.posexplode(F.when(words <= most_words, F.array("content")).otherwise(cut)).alias("piece", "text"))
