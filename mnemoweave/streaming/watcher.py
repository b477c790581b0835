"""A running watch of a folder: events kept in a table, drained once each, with counts and an orderly stop."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.sources import changes


class Watcher:
    """Watches ``root``; ``home`` holds listings, checkpoint and events, so that a new object goes on where the last stopped.

    A batch of the stream is written under its number, over what an attempt before may have left: events are kept once.
    """

    def __init__(self, spark: SparkSession, root: str, home: str, extensions: tuple[str, ...] = (), ignored_dirs: tuple[str, ...] = (), existing: str = "known", every: str = "100 milliseconds"):
        changes.register(spark)
        self.spark, self.home = spark, home.rstrip("/")
        rows = spark.readStream.format(changes.FORMAT).options(path=root, state=f"{self.home}/listings", extensions=",".join(extensions), ignored_dirs=",".join(ignored_dirs), existing=existing).load()
        self.drained = _last(self._all())
        self.query = rows.writeStream.option("checkpointLocation", f"{self.home}/checkpoint").trigger(processingTime=every).foreachBatch(self._keep).start()

    def _keep(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.home}/events/batch={number}")

    def _all(self) -> DataFrame:
        """(path, event, at, batch) of everything kept."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/events")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{changes.EVENTS}, batch long")
        return self.spark.read.schema(f"{changes.EVENTS}, batch long").parquet(f"{self.home}/events")

    def catch_up(self) -> None:
        """Return when all that has changed by now is kept."""
        self.query.processAllAvailable()

    def drain(self) -> DataFrame:
        """Events kept since the last call, in order of batches."""
        found = self._all()
        last = _last(found)
        out = found.where((F.col("batch") > self.drained) & (F.col("batch") <= last)).orderBy("batch", "path").drop("batch")
        self.drained = last
        return out

    def wait(self, seconds: float, every: float = 0.1) -> bool:
        """Whether an event that is not drained is there before the time is over."""
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            if _last(self._all()) > self.drained:
                return True
            time.sleep(every)
        return False

    def stats(self) -> dict[str, int]:
        """Events by kind, batches with events, failures of the stream, and whether it runs."""
        counts = {r["event"]: r["n"] for r in self._all().groupBy("event").agg(F.count(F.lit(1)).alias("n")).collect()}
        batches = self._all().select("batch").distinct().count()
        return {k: counts.get(k, 0) for k in ("Created", "Modified", "Deleted")} | {"batches": batches, "errors": int(self.query.exception() is not None), "running": int(self.query.isActive)}

    def stop(self) -> None:
        self.query.stop()


def _last(events: DataFrame) -> int:
    return events.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
