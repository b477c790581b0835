"""The capture queue on storage: logs of fragments, claims and outcomes, from which the state of each fragment follows.

A batch is claimed by writing its ids under its number, and done by writing its outcomes under the same number; both are
whole or not there.  A claim without outcomes holds for the time of a lease, then its fragments are pending again: after
a crash nothing is lost, and what has an outcome is not taken again.  A batch that crashed may also be run again under its
number, with the same fragments.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave import schemas
from mnemoweave.storage import materialise
from mnemoweave.streaming import spool

CLAIMS = "id long, at long"
OUTCOMES = "id long, status string, error string, at long"


class Queue:
    def __init__(self, spark: SparkSession, home: str, lease: int = spool.STALE_SECONDS):
        self.spark, self.home, self.lease = spark, home.rstrip("/"), lease
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)

    def _batches(self, log: str) -> list[str]:
        """Numbers of the batches whose part of a log was completed."""
        if not self.fs.exists(self._path(log)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(log)) if s.isDirectory()]
        return sorted(n for n in names if self.fs.exists(self._path(f"{log}/{n}/_SUCCESS")))

    def _log(self, log: str, schema: str) -> DataFrame:
        """The completed parts of a log, with their batch."""
        done = self._batches(log)
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch_id string")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.home}/{log}/{b}" for b in done])
        return rows.withColumn("batch_id", F.regexp_extract("_metadata.file_path", rf"/{log}/([^/]+)/", 1))

    def insert(self, rows: DataFrame, now: int) -> int:
        """Append fragments (source_id, text, ...), with ids that go on; those without a text or a source are refused."""
        good = materialise(spool.valid(rows))
        last = self._log("fragments", "id long").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        names = [f.name for f in schemas.FRAGMENTS]
        numbered = good.rdd.zipWithIndex().map(lambda x: {**x[0].asDict(), "id": x[1] + last + 1})  # one after the other, as claims go by them
        kept = self.spark.createDataFrame(numbered, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in good.schema if f.name != 'id')}, id long")
        for c in names:
            if c not in kept.columns:
                kept = kept.withColumn(c, F.lit(None).cast(schemas.FRAGMENTS[c].dataType))
        kept = kept.withColumns({"created_at": F.coalesce("created_at", F.lit(now).cast("long")), "category": F.coalesce("category", F.lit("Episodic")), "extraction_status": F.lit("pending")})
        kept.select(names).write.parquet(f"{self.home}/fragments/{now}-{uuid4().hex}")
        return kept.count()

    def fragments(self, now: int) -> DataFrame:
        """Every fragment in its state: that of its last outcome, ``extracting`` under a claim that holds, else ``pending``."""
        rows = self._log("fragments", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FRAGMENTS)).drop("batch_id", "extraction_status", "extracted_at", "error")
        ends = self._log("outcomes", OUTCOMES).groupBy("id").agg(F.max_by(F.struct("status", "error", "at", "batch_id"), F.struct("at", "batch_id")).alias("end"))
        holds = self._log("claims", CLAIMS).where(F.col("at") > now - self.lease).groupBy("id").agg(F.max_by(F.struct("at", "batch_id"), F.struct("at", "batch_id")).alias("claim"))
        rows = rows.join(ends, "id", "left").join(holds, "id", "left")
        ended = F.col("end.status").isNotNull()
        open_claim = F.col("claim").isNotNull() & (~ended | ((F.col("end.status") == "pending") & (F.col("claim.at") > F.col("end.at"))))
        return rows.withColumns({
            "extraction_status": F.when(open_claim, "extracting").when(ended, F.col("end.status")).otherwise("pending"),
            "extracted_at": F.when(F.col("end.status") == "extracted", F.col("end.at")),
            "batch_id": F.when(open_claim, F.col("claim.batch_id")).otherwise(F.col("end.batch_id")),
            "error": F.when(~open_claim, F.col("end.error")),
        }).select(*[f.name for f in schemas.FRAGMENTS])

    def claim(self, now: int, limit: int = spool.BATCH) -> str | None:
        """The number of a new batch of the next pending fragments; None if there are none."""
        chosen = materialise(spool.claim(self.fragments(now), limit).select("id", F.lit(now).cast("long").alias("at")))
        if chosen.isEmpty():
            return None
        batch = f"{now}-{uuid4().hex}"
        chosen.write.parquet(f"{self.home}/claims/{batch}")
        return batch

    def claimed(self, batch: str) -> DataFrame:
        ids = self._log("claims", CLAIMS).where(F.col("batch_id") == batch).select("id")
        return self._log("fragments", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FRAGMENTS)).drop("batch_id").join(ids, "id", "left_semi")

    def run(self, batch: str, extract: Callable[[DataFrame], None], now: int) -> dict[str, str | None]:
        """Extract a claimed batch and commit its outcomes; {source: error or None}.

        ``extract`` takes (source_id, text, category, ids), a row for each source.  If it raises, the sources are halved until
        those that raise stand alone: they are failed, the others extracted.  ``extract`` may see a source twice, so what it
        writes must be keyed by source and text, as ingestion is.  A batch that was committed before is left as it is.
        """
        if batch in self._batches("outcomes"):
            return {}
        rows = materialise(spool.by_source(self.claimed(batch)))
        errors = _isolated(rows, [r["source_id"] for r in rows.select("source_id").orderBy("source_id").collect()], extract)
        told = self.spark.createDataFrame(list(errors.items()), "source_id string, error string")
        out = rows.join(told, "source_id").select(F.explode("ids").alias("id"), F.when(F.col("error").isNull(), "extracted").otherwise("failed").alias("status"), "error", F.lit(now).cast("long").alias("at"))
        out.write.mode("overwrite").parquet(f"{self.home}/outcomes/{batch}")  # over what a crash left
        return errors

    def work(self, extract: Callable[[DataFrame], None], now: int | None = None, limit: int = spool.BATCH) -> dict[str, str | None]:
        """Claim a batch and run it."""
        now = int(time.time()) if now is None else now
        batch = self.claim(now, limit)
        return self.run(batch, extract, now) if batch else {}

    def retry_failed(self, now: int) -> int:
        """Failed fragments are pending again."""
        failed = materialise(self.fragments(now).where("extraction_status = 'failed'").select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(now).cast("long").alias("at")))
        failed.write.parquet(f"{self.home}/outcomes/{now}-{uuid4().hex}")
        return failed.count()


def _isolated(rows: DataFrame, sources: list[str], extract: Callable[[DataFrame], None]) -> dict[str, str | None]:
    if not sources:
        return {}
    try:
        extract(rows.where(F.col("source_id").isin(sources)))
        return dict.fromkeys(sources)
    except Exception as e:  # noqa: BLE001  whatever a source raises is its outcome
        if len(sources) == 1:
            return {sources[0]: f"{type(e).__name__}: {e}"[:1000]}
    half = len(sources) // 2
    return _isolated(rows, sources[:half], extract) | _isolated(rows, sources[half:], extract)
