"""Readers: documents, sessions, repositories, overflow files, lore, evaluation sets, settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave import schemas
from mnemoweave.functions import path_category
from mnemoweave.operators.lookups import watched
from mnemoweave.sources import tree

#: Fixed value: how sources of lore begin.
LORE = "lore://entry/"
LORE_MANIFEST = "lore://manifest"
IGNORED_DIRS = (".git", "node_modules", "target", "__pycache__", ".venv")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(source_document, text, memory_category) of every Markdown file under a folder; blank ones are left out."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), f"^{root.rstrip('/')}/", "")
    return rows.select(path.alias("source_document"), F.col("value").alias("text"), path_category(path).alias("memory_category")).where(F.trim("text") != "")


def inline(spark: SparkSession, text: str, source_id: str, category: str = "Episodic") -> DataFrame:
    return spark.createDataFrame([(source_id, text, category)], "source_document string, text string, memory_category string")


def sessions(spark: SparkSession, root: str, project: str | None = None, since: int | None = None) -> DataFrame:
    """(session, folder, modified, text) of JSONL files, by a part of their path and by their modification time."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    path = F.col("_metadata.file_path")
    rows = rows.select(path.alias("session"), F.element_at(F.split(path, "/"), -2).alias("folder"), F.unix_seconds("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    if project is not None:
        rows = rows.where(F.contains("session", F.lit(project)))
    return rows.where(F.col("modified") >= since) if since is not None else rows


def repository(spark: SparkSession, root: str, extensions: list[str] | None = None, ignored_dirs: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """(path, content) of a source tree, without ignored folders and what ``.gitignore`` files of any folder rule out."""
    rows = tree.walked(spark, root, ignored_dirs)
    return tree.contents(rows.where(watched(F.col("path"), extensions, [], [])) if extensions else rows, root)


def prompts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates by name: the ``.txt`` files of a folder, which are few."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.collect()}


def expected_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(document, name, entity_type, aliases) of ``<document>.expected.json`` files: what should be found in each document."""
    schema = "entities array<struct<name:string,type:string,aliases:array<string>>>"
    rows = spark.read.schema(schema).json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.expected.json")
    document = F.regexp_extract("_metadata.file_path", r"([^/]+)\.expected\.json$", 1)
    return rows.select(document.alias("document"), F.explode("entities").alias("e")).where(F.trim("e.name") != "").select("document", F.trim("e.name").alias("name"), "e.type", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases")).withColumnRenamed("type", "entity_type")


def overflow(spark: SparkSession, root: str) -> DataFrame:
    """Overflow files with ``valid``: version 1 with a source and a text; a missing category is Episodic."""
    rows = spark.read.schema(schemas.OVERFLOW).json(root, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*.json").select("*", F.col("_metadata.file_path").alias("file"))
    ok = (F.col("version") == 1) & (F.trim("source_id") != "") & (F.trim("text") != "")
    return rows.withColumns({"category": F.coalesce("category", F.lit("Episodic")), "valid": F.coalesce(ok, F.lit(False))})


def lore(spark: SparkSession, path: str) -> DataFrame:
    """(source_document, text, sha256) of a JSON array of strings."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "text"))
    return rows.select(F.concat(F.lit(LORE), F.col("i")).alias("source_document"), "text", F.sha2("text", 256).alias("sha256"))


def evaluation_queries(spark: SparkSession, path: str, types: tuple[str, ...]) -> DataFrame:
    """Evaluation queries; ValueError if one lacks an id, a known type, or an expected entity."""
    schema = "id string, type string, question string, expected_entities array<string>, expected_answer_keywords array<string>, expected_source_documents array<string>, min_relevant_chunks int, time_context struct<start:bigint,end:bigint>, hops_required int"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.where(F.col("id").isNull() | F.col("question").isNull() | ~F.coalesce(F.col("type").isin(*types), F.lit(False)) | (F.size(F.coalesce("expected_entities", F.array().cast("array<string>"))) == 0))
    if not bad.isEmpty():
        raise ValueError(f"unusable evaluation query: {bad.first()['id']}")
    return rows


@dataclass(frozen=True)
class Settings:
    """What may be set in a TOML file, by group; unknown keys are ignored, wrong values refused."""

    max_chunk_tokens: int = 800
    chunk_overlap_tokens: int = 100
    auto_merge_threshold: float = 0.85
    review_threshold: float = 0.70
    tier1_budget_pct: float = 0.10
    tier2_budget_pct: float = 0.60
    anchor_count_min: int = 3
    anchor_count_max: int = 10
    neighborhood_max_entities: int = 40
    similarity_weight: float = 0.80
    pagerank_weight: float = 0.20
    decay_half_life_days: float = 30
    edge_prune_threshold: float = 0.01
    merge_similarity: float = 0.90
    alias_overlap: float = 0.80
    max_exchange_tokens: int = 1200
    spool_threshold: int = 50
    spool_retain_days: int = 30
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        unit = [f.name for f in fields(self) if f.name.endswith(("_pct", "_threshold", "_weight", "_similarity", "_overlap")) and f.name != "spool_threshold"]
        wrong = [n for n in unit if not 0 <= getattr(self, n) <= 1]
        wrong += [f.name for f in fields(self) if f.type == "int" and getattr(self, f.name) <= 0]
        if self.tier1_budget_pct + self.tier2_budget_pct > 1:
            wrong.append("tier budgets")
        if self.anchor_count_min > self.anchor_count_max:
            wrong.append("anchor counts")
        if self.review_threshold > self.auto_merge_threshold:
            wrong.append("review_threshold")
        if wrong:
            raise ValueError(f"wrong settings: {', '.join(wrong)}")


def settings(path: str) -> Settings:
    with open(path, "rb") as f:
        read = tomllib.load(f)
    flat = {k: v for group in read.values() if isinstance(group, dict) for k, v in group.items()} | {k: v for k, v in read.items() if not isinstance(v, dict)}
    known = {f.name for f in fields(Settings)} - {"extra"}
    return Settings(**{k: v for k, v in flat.items() if k in known})
