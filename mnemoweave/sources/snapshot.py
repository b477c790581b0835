"""Versioned snapshots of a graph: each save is a folder of tables, and a pointer names the one that holds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave import schemas
from mnemoweave.operators.relations import export_subgraph
from mnemoweave.state import GraphState

KEPT = 4
POINTER, MANIFEST = "_CURRENT", "_MANIFEST"
VECTORS = "embeddings"


class _Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write aside, then rename over: readers see the old or the new text."""
        aside = self.path(f".{name}.{uuid4().hex}")
        out = self.fs.create(aside)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(aside, self.path(name), options)

    def sizes(self, name: str) -> dict[str, int]:
        """Bytes of each data file in a folder; none if it is missing."""
        if not self.fs.exists(self.path(name)):
            return {}
        found = self.fs.listStatus(self.path(name))
        return {f.getPath().getName(): f.getLen() for f in found if not f.getPath().getName().startswith(("_", "."))}

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Kept versions, the one that holds first."""
    return (_Folder(spark, root).read(POINTER) or "").split()


def _sums(df: DataFrame) -> dict[str, int]:
    """Rows of a table, and a checksum of all its values that the order of rows does not change."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("a"), F.coalesce(F.sum(F.xxhash64(*df.columns).bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0)).alias("b")).first()
    return {"rows": row["rows"], "sums": [row["a"], row["b"]]}


def save(spark: SparkSession, state: GraphState, root: str, vectors: DataFrame | None = None) -> str:
    """Write a new version and point at it; the last four are kept.  An empty graph does not replace one that is not.

    A version's manifest, the files of each table with their lengths, its rows and checksums, is written last, from what was
    written: a version without it was never completed.  ``vectors`` are stored with the graph they were made from.
    """
    folder, old = _Folder(spark, root), versions(spark, root)
    if old and state.entities.isEmpty() and not load(spark, root).entities.isEmpty():
        raise ValueError("refusing to replace a graph by an empty one")
    version = f"v-{uuid4().hex}"
    tables = state._asdict() | ({VECTORS: vectors} if vectors is not None else {})
    manifest = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
        manifest[name] = {"files": folder.sizes(f"{version}/{name}")} | _sums(spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}"))
    folder.replace(f"{version}/{MANIFEST}", json.dumps(manifest))
    folder.replace(POINTER, "\n".join([version, *old][:KEPT]))
    for gone in old[KEPT - 1 :]:
        folder.drop(gone)
    return version


def intact(spark: SparkSession, root: str, version: str, thorough: bool = False) -> bool:
    """Whether a version has its manifest and every file in it has the length noted; ``thorough`` reads all rows too."""
    folder = _Folder(spark, root)
    text = folder.read(f"{version}/{MANIFEST}")
    manifest = json.loads(text) if text else {}
    if not set(GraphState._fields) <= manifest.keys() or any(folder.sizes(f"{version}/{n}") != m["files"] for n, m in manifest.items()):
        return False
    if not thorough:
        return True
    try:
        return all(_sums(spark.read.parquet(f"{root}/{version}/{n}")) == {k: m[k] for k in ("rows", "sums")} for n, m in manifest.items())
    except PySparkException:  # a file that cannot be read
        return False


def _holding(spark: SparkSession, root: str, thorough: bool = False) -> str | None:
    return next((v for v in versions(spark, root) if intact(spark, root, v, thorough)), None)


def load(spark: SparkSession, root: str, version: str | None = None) -> GraphState:
    """The graph of a version, or of the newest whose files are all there; an empty one if there is none."""
    found = version or _holding(spark, root)
    if found is None:
        return GraphState.empty(spark)
    return GraphState(**{n: spark.read.parquet(f"{root}/{found}/{n}") for n in GraphState._fields})


def load_vectors(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(entity_id, sha256, vector) stored with that version; none if there are none."""
    found = version or _holding(spark, root)
    if found is None or VECTORS not in json.loads(_Folder(spark, root).read(f"{found}/{MANIFEST}") or "{}"):
        return spark.createDataFrame([], schemas.STORED_EMBEDDINGS)
    return spark.read.parquet(f"{root}/{found}/{VECTORS}")


def recover(spark: SparkSession, root: str) -> GraphState:
    """The newest version whose tables have the rows and checksums of its manifest."""
    found = _holding(spark, root, thorough=True)
    return load(spark, root, found) if found else GraphState.empty(spark)


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small text file, such as a report, written aside and moved over an old one."""
    _Folder(spark, folder).replace(name, text)


def json_rows(state: GraphState) -> DataFrame:
    """(kind, json): every row of the graph as JSON."""
    return _as_json(state._asdict())


def subgraph_json(state: GraphState, ids: Sequence[str]) -> DataFrame:
    """(kind, json): the entities of some ids, the edges between them and the chunks of those, as JSON."""
    return _as_json(dict(zip(("entities", "edges", "chunks"), export_subgraph(state, ids))))


def _as_json(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
