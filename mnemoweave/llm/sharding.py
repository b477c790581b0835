"""Sharding by balanced label propagation.

Documents of equal text are linked, each to a hub that stands for the text, so a text of n copies has n links.  Shards
hold equally many rows (law ``rows``: counts at most one apart); within that, as few texts as possible lie in several
shards.  Every linked row starts in a shard by hash.  A cell is the rows that a text has in a shard.  In each round the
hub's label becomes the shard with room that holds most of its rows, a join brings that label to its smaller cells, and
their rows ask to move there.  Requests are granted by the size of the cell that calls, up to the room of its shard;
rooms are what the quotas, with a slack while rounds go on, leave besides linked rows, since rows without a link go
wherever places are left.  Rounds end when nothing moves.  Then the smallest cells leave shards over their quota, and
they and the rows without a link fill the places that are left, text after text.  A text with more copies than a shard
has places fills several.

Rows of equal text are alike, so cells carry counts; at the end the rows of a text that lies in several shards are
numbered and dealt to its cells.  Rows that repeat an id are rows of their own.  Null texts have no link, the size 1 and
the checksum 0; a null id comes last in its shard.  Extra columns take no part.  Texts of any length are hashed where
they are read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.llm.common import stored, table
from mnemoweave.llm.ordered import running_totals

SHARDS = 8
ROUNDS = 12
SLACK = 1.5  # times its quota that a shard may hold of linked rows while rounds go on
_HUB = ["hub_a", "hub_b"]
_POOL = -1  # of rows for which any shard will do


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hub_a, hub_b): 128 bits of hash stand for a text."""
    text = F.col("text")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32")
    hub = [F.when(text.isNotNull(), F.xxhash64(*salt, text)).alias(c) for c, salt in zip(_HUB, ([], [F.lit("hub")]))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), crc, *hub)


def _by_shard(values: list[int], shard: str | Column) -> Column:
    """A number of each shard."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col(shard) if isinstance(shard, str) else shard) + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    return [found.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (hub_a, hub_b, shard, n) after the rounds, none over its shard's quota; what finds no place is in shard -1."""
    shards = len(quotas)
    loads = _loads(cells, shards)
    for _ in range(rounds):
        rooms = [max(0, int(SLACK * q) - n) for q, n in zip(quotas, loads)]
        best = F.max(F.when(_by_shard(rooms, "shard") > 0, F.struct("n", (-F.col("shard")).alias("first"))))
        labels = cells.groupBy(*_HUB).agg(best.alias("label"), F.count(F.lit(1)).alias("m")).where("m > 1 and label is not null")
        asking = cells.join(labels, _HUB).where(F.struct("n", (-F.col("shard")).alias("first")) < F.col("label"))
        asking = stored(asking.select(*_HUB, "shard", "n", (-F.col("label.first")).alias("to"), F.col("label.n").alias("calls")))
        wanted = dict(asking.groupBy("to").agg(F.sum("n")).collect())
        if not wanted:
            break
        if all(n <= rooms[s] for s, n in wanted.items()):
            moves = asking.withColumn("take", F.col("n"))
        else:
            turn = running_totals(asking, [F.desc("calls"), *_HUB, "shard"], key="to", weight="n")
            moves = turn.withColumn("take", F.greatest(F.lit(0), F.least("n", _by_shard(rooms, "to") - F.col("_total") + F.col("n")))).where("take > 0")
        gone = moves.select(*_HUB, "shard", (-F.col("take")).alias("n"))
        come = moves.select(*_HUB, F.col("to").alias("shard"), F.col("take").alias("n"))
        cells = stored(cells.unionByName(gone).unionByName(come).groupBy(*_HUB, "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        loads = _loads(cells, shards)
    over = [max(0, n - q) for q, n in zip(quotas, loads)]
    if not any(over):
        return cells
    turn = running_totals(cells.where(_by_shard(over, "shard") > 0), ["n", *_HUB], key="shard", weight="n")
    out = turn.withColumn("take", F.greatest(F.lit(0), F.least("n", _by_shard(over, "shard") - F.col("_total") + F.col("n")))).where("take > 0")
    gone = out.select(*_HUB, "shard", (-F.col("take")).alias("n"))
    pool = out.groupBy(*_HUB).agg(F.sum("take").alias("n")).withColumn("shard", F.lit(_POOL))
    return stored(cells.unionByName(gone).groupBy(*_HUB, "shard").agg(F.sum("n").alias("n")).where("n > 0").unionByName(pool))


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of (doc_id, text)."""
    rows = stored(sized(docs))
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]

    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int")
    cells = rows.where("hub_a is not null").groupBy(*_HUB, start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy(*_HUB).agg(F.collect_list(F.struct("shard", "n")).alias("c"), F.sum("n").alias("m")).where("m > 1")  # at most one entry for each shard
    cells = stored(linked.select(*_HUB, F.explode("c").alias("c")).select(*_HUB, "c.shard", "c.n"))
    cells = propagate(cells, quotas, rounds)

    hubs = stored(cells.groupBy(*_HUB).agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("cells")))
    whole = rows.join(hubs, _HUB, "left").withColumn("shard", F.when(F.coalesce("cells", F.lit(0)) < 2, F.coalesce("shard", F.lit(_POOL))))
    placed = stored(whole.drop("cells"))
    split = running_totals(placed.where("shard is null").drop("shard"), [*_HUB, "doc_id"])
    places = running_totals(cells.join(hubs.where("cells > 1").select(*_HUB), _HUB, "left_semi"), [*_HUB, "shard"], weight="n")
    places = places.select(*_HUB, "shard", (F.col("_total") - F.col("n")).alias("after"), F.col("_total").alias("upto"))
    dealt = split.join(places, _HUB).where("_total > after and _total <= upto").select(*placed.columns)  # both are numbered by hub
    placed = placed.where("shard is not null").unionByName(dealt)

    taken = _loads(placed.where(F.col("shard") >= 0).select("shard", F.lit(1).alias("n")), shards)
    ends, at = [], 0
    for q, t in zip(quotas, taken):
        at += q - t
        ends.append(at)
    pool = running_totals(placed.where(F.col("shard") < 0), [*_HUB, "doc_id"])
    free = sum((F.when(F.col("_total") > e, 1).otherwise(0) for e in ends), F.lit(0))
    done = placed.where(F.col("shard") >= 0).unionByName(pool.withColumn("shard", free).drop("_total"))

    slots = running_totals(done.select("doc_id", "size", "text_crc32", "shard"), [F.asc_nulls_last("doc_id"), "text_crc32", "size"], key="shard")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_total") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
