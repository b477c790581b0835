"""The capture queue: fragments, their states, batches, and the stream that feeds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemoweave.schemas import FRAGMENTS, SPOOL_STATES

BATCH = 50
RETAINED_DAYS = 30
STALE_SECONDS = 3600


def histogram(fragments: DataFrame) -> DataFrame:
    """(status, n) for every state, zeros included, and the total."""
    states = fragments.sparkSession.createDataFrame([(s,) for s in SPOOL_STATES], "status string")
    n = fragments.groupBy(F.col("extraction_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    by = states.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return by.unionByName(fragments.agg(F.lit("total").alias("status"), F.count(F.lit(1)).alias("n")))


def valid(rows: DataFrame) -> DataFrame:
    """Fragments with a text and a source."""
    return rows.where((F.trim("text") != "") & (F.trim("source_id") != ""))


def claim(fragments: DataFrame, limit: int = BATCH) -> DataFrame:
    """The next pending fragments, those of a source together and oldest first."""
    return fragments.where("extraction_status = 'pending'").orderBy("source_id", "created_at", "id").limit(limit)


def moved(fragments: DataFrame, ids: DataFrame, status: str, now: int | None = None, batch_id: str | None = None) -> DataFrame:
    """Fragments with the state of ``ids`` (id, error) changed."""
    hit = F.col("_hit").isNotNull()
    j = fragments.join(ids.select("id", F.lit(1).alias("_hit"), F.col("error").alias("_e") if "error" in ids.columns else F.lit(None).cast("string").alias("_e")), "id", "left")
    return j.withColumns({
        "extraction_status": F.when(hit, status).otherwise(F.col("extraction_status")),
        "extracted_at": F.when(hit & F.lit(status == "extracted"), F.lit(now)).otherwise(F.col("extracted_at")),
        "batch_id": F.when(hit & F.lit(batch_id is not None), F.lit(batch_id)).otherwise(F.col("batch_id")),
        "error": F.when(hit, F.col("_e")).otherwise(F.col("error")),
    }).select(*fragments.columns)


def reset_stale(fragments: DataFrame, now: int, after: int = STALE_SECONDS) -> DataFrame:
    """Fragments that began to be extracted too long ago are pending again."""
    stale = (F.col("extraction_status") == "extracting") & (F.coalesce("extracted_at", "created_at") < now - after)
    return fragments.withColumn("extraction_status", F.when(stale, "pending").otherwise(F.col("extraction_status")))


def retry_failed(fragments: DataFrame) -> DataFrame:
    failed = F.col("extraction_status") == "failed"
    return fragments.withColumns({"error": F.when(~failed, F.col("error")), "extraction_status": F.when(failed, "pending").otherwise(F.col("extraction_status"))})


def retained(fragments: DataFrame, now: int, days: int = RETAINED_DAYS) -> DataFrame:
    """Without fragments extracted longer ago than ``days``; failed ones stay."""
    return fragments.where(~F.coalesce((F.col("extraction_status") == "extracted") & (F.col("extracted_at") < now - days * 86400), F.lit(False)))


def failed_sample(fragments: DataFrame, limit: int = 20) -> DataFrame:
    return fragments.where("extraction_status = 'failed'").orderBy(F.desc("id")).limit(limit)


def recent_batches(fragments: DataFrame, limit: int = 10, sources: int = 5) -> DataFrame:
    """(batch_id, extracted_at, fragments, sources): the latest batches with some of their sources."""
    g = fragments.where("batch_id is not null").groupBy("batch_id").agg(F.max("extracted_at").alias("extracted_at"), F.count(F.lit(1)).alias("fragments"))
    per = fragments.where("batch_id is not null").groupBy("batch_id", "source_id").agg(F.count(F.lit(1)).alias("k"))
    top = g.orderBy(F.desc("extracted_at"), "batch_id").limit(limit)
    from pyspark.sql import Window

    placed = per.join(top.select("batch_id"), "batch_id", "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("batch_id").orderBy("source_id"))).where(F.col("i") <= sources)
    names = placed.groupBy("batch_id").agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    return top.join(names, "batch_id", "left")


def by_source(claimed: DataFrame) -> DataFrame:
    """(source_id, text, category, ids): a source's claimed fragments as one text, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", "text", "category")))
    g = claimed.groupBy("source_id").agg(ordered.alias("x"))
    return g.select("source_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n\n").alias("text"), F.col("x")[0]["category"].alias("category"), F.transform("x", lambda s: s["id"]).alias("ids"))


def already_stored(overflow: DataFrame, hashes: DataFrame) -> DataFrame:
    """Overflow rows with ``known``: whether the stored hash of their source is that of their text."""
    h = overflow.withColumn("sha256", F.sha2("text", 256)).join(hashes.select(F.col("document").alias("source_id"), "sha256", F.lit(True).alias("hit")), ["source_id", "sha256"], "left")
    return h.withColumn("known", F.coalesce("hit", F.lit(False))).drop("hit")


def capture(spark: SparkSession, folder: str, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, most_files: int = 100) -> StreamingQuery:
    """Read new fragment files as they come and append them to the spool, or hand each batch to ``on_batch``.

    Offsets in the checkpoint take the place of claims: a fragment is read once, also after a restart.
    """
    rows = valid(spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", most_files).json(folder))
    rows = rows.withColumns({"extraction_status": F.coalesce("extraction_status", F.lit("pending")), "category": F.coalesce("category", F.lit("Episodic"))})
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(on_batch).start() if on_batch else writer.format("parquet").option("path", out).start()


def threshold_batches(rows: DataFrame, least: int, run: Callable[[DataFrame], None]) -> bool:
    """Run a job over pending rows once there are enough of them, with twice the threshold or 100 at most."""
    pending = rows.where("extraction_status = 'pending'")
    if pending.limit(least).count() < least:
        return False
    run(claim(rows, max(2 * least, 100)))
    return True
