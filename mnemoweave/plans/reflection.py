"""Finding and carrying out merges, upkeep, and what is written back about entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import cosine, stable_id
from mnemoweave.operators.aggregates import low_access_count
from mnemoweave.operators.relations import temporal_chain
from mnemoweave.plans import mutations, similarity
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise

AUTO_APPROVE = 0.95
PIECE_ROWS = 2048  # of a name's entities in one task, against as many others of the name


def _sized(state: GraphState) -> DataFrame:
    n = state.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return state.entities.join(n, F.col("id") == F.col("entity_id"), "left").select("id", "canonical_name", "aliases", "entity_type", F.coalesce("n", F.lit(0)).alias("n"))


def _kept(pairs: DataFrame) -> DataFrame:
    """(keep_id, merge_id, confidence, method): the side with more chunks stays, the first at equal numbers."""
    swap = F.col("n_b") > F.col("n_a")
    return pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("keep_id"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("merge_id"), "confidence", "method")


def alias_candidates(state: GraphState, threshold: float = 0.8) -> DataFrame:
    """Pairs of one type whose sets of lower-cased names and aliases have a Jaccard similarity of ``threshold`` or more.

    Pairs meet under names of their prefixes only: in an order from rare to common, two sets that similar share a name
    among the first n - ceil(threshold * n) + 1 of either, so that a common alias does not pair everything.  A pair is
    given out under the first prefix name it shares and needs no other exchange.
    """
    return _alias_pairs(_prefixes(_named(_sized(state)), threshold), threshold)


def _named(e: DataFrame) -> DataFrame:
    return materialise(e.withColumn("names", F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), F.lower))))


def _prefixes(e: DataFrame, threshold: float) -> DataFrame:
    """(id, entity_type, n, names, common, prefix, name, f): each entity under each name of its prefix, rarest first, with the name's frequency.

    ``common`` is how many of its names others of its type have, a null among them counted.
    """
    each = e.select("id", "entity_type", F.explode("names").alias("name"))
    common = each.groupBy("entity_type", "name").agg(F.count(F.lit(1)).alias("f"))
    placed = each.join(common, ["entity_type", "name"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "name"))).alias("placed"))
    size = F.size("placed")
    first = F.slice("placed", 1, F.greatest(F.lit(1), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")))
    common = F.size(F.filter("placed", lambda x: x["f"] > 1))
    rows = e.join(placed.select("id", common.alias("met"), first.alias("first")), "id")
    common = F.col("met") + F.exists("names", lambda x: x.isNull()).cast("int")
    return rows.select("id", "entity_type", "n", "names", common.alias("common"), F.transform("first", lambda x: x["name"]).alias("prefix"), F.explode("first").alias("x")).select("*", "x.name", "x.f").drop("x")


def _alias_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``_prefixes``.  A name of many entities is cut into pieces, each two of which meet, so that no task has all its pairs.

    Entities of which others have one name only are paired with each other by that name alone, in code small enough to be
    compiled; all other pairs compare names.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("f > 1").withColumns({"size": F.size("names"), "pieces": F.ceil(F.col("f") / PIECE_ROWS).cast("int")})
    rows = materialise(rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")))
    key, mine, last = ["entity_type", "name", "p", "q"], F.col("mine"), F.col("pieces") - 1

    def side(some: DataFrame, x: str, own: str, other: str, low: Column, high: Column, *more: str) -> DataFrame:
        placed = some.withColumn(own, mine).withColumn(other, F.explode(F.sequence(low, high)))
        return placed.select(*key, F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "size", *more))).repartition(parts, *key)

    def kept(met: DataFrame, both: Column) -> DataFrame:
        confidence = both / (F.col("size_a") + F.col("size_b") - both)
        ahead = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))  # more chunks, or the first
        side_of = lambda c: F.when(c, F.col("a")).otherwise(F.col("b"))
        return met.where(confidence >= threshold).select(side_of(ahead).alias("keep_id"), side_of(~ahead).alias("merge_id"), confidence.alias("confidence"), F.lit("alias_overlap").alias("method"))

    lone = rows.where("common = 1")
    met = side(lone, "a", "p", "q", mine, last).join(side(lone, "b", "q", "p", F.lit(0), mine), key)
    alone = kept(met.where((F.col("p") < F.col("q")) | (F.col("a") < F.col("b"))), F.lit(1))
    grid = lambda some, x, own, other: side(some, x, own, other, F.lit(0), last, "common", "names", "prefix")
    met = grid(rows.where("common > 1"), "a", "p", "q").join(grid(rows, "b", "q", "p"), key).where((F.col("common_b") == 1) | (F.col("a") < F.col("b")))
    both = F.size(F.array_intersect("names_a", "names_b"))
    met = met.withColumn("both", both).where((F.col("both") == 1) | (F.col("name") == F.array_intersect("prefix_a", "prefix_b")[0]))
    return alone.unionByName(kept(met, F.col("both")))


def alias_merges(state: GraphState, threshold: float = 0.8) -> DataFrame:
    """``merge_order(alias_candidates(state, threshold))`` without the pairs of plain groups.

    A group is plain if its entities, of one type and of equally many names, share one name, and no entity of it shares
    another: all its pairs have one confidence.  In the order of ids each entity then takes in what has fewer chunks than
    it, or as many and a later id, so that an entity goes to the first one in that order that is before it by chunks and id.
    What is in other groups is paired.
    """
    e = _named(_sized(state))
    each = e.select("id", "entity_type", "n", F.size("names").alias("size"), F.explode("names").alias("name"))
    alike = Window.partitionBy("entity_type", "name")
    met = each.withColumn("f", F.count(F.lit(1)).over(alike)).where("f > 1")
    met = met.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")))
    met = materialise(met.withColumn("plain", (F.max("shared").over(alike) == 1) & (F.min("size").over(alike) == F.max("size").over(alike))))
    confidence = F.lit(1.0) / (2 * F.col("size") - 1)
    before = F.max("n").over(alike.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    plain = met.where(F.col("plain") & (confidence >= threshold)).withColumn("leads", before.isNull() | (F.col("n") > before))
    order = alike.orderBy(F.desc("n"), F.desc("leads"), "id").rowsBetween(Window.unboundedPreceding, -1)
    to = plain.withColumn("keep_id", F.last(F.when(F.col("leads"), F.col("id")), ignorenulls=True).over(order)).where("keep_id is not null")
    taken = to.select("keep_id", F.col("id").alias("merge_id"), confidence.alias("confidence"), F.lit("alias_overlap").alias("method"))
    rest = e.join(met.where("not plain").select("id").distinct(), "id", "left_semi")
    return materialise(taken.unionByName(merge_order(_alias_pairs(_prefixes(rest, threshold), threshold))))


def vector_candidates(state: GraphState, embeddings: DataFrame, threshold: float = 0.9, exact: bool = True) -> DataFrame:
    """Pairs of one type whose (entity_id, vector) rows have a cosine of ``threshold`` or more.

    ``exact`` compares blocks within bounds; else pairs meet in tables of random hyperplanes, which miss few and whose work
    grows little faster than the entities.
    """
    e = materialise(_sized(state).select("id", "entity_type", "n"))
    v = e.join(embeddings.withColumnRenamed("entity_id", "id"), "id").select("id", F.col("entity_type").alias("kind"), "vector")
    pairs = (similarity.exact_pairs if exact else similarity.hashed_pairs)(v, threshold)
    side = lambda x: e.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    return _kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", F.col("similarity").alias("confidence"), F.lit("embedding").alias("method")))


def merge_candidates(*found: DataFrame) -> DataFrame:
    """The best row for each unordered pair, by falling confidence."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    pair = [F.least("keep_id", "merge_id").alias("_a"), F.greatest("keep_id", "merge_id").alias("_b")]
    best = rows.groupBy(*pair).agg(F.max_by(F.struct("keep_id", "merge_id", "confidence", "method"), F.struct("confidence", "method")).alias("best"))
    return best.select("best.*").orderBy(F.desc("confidence"), "keep_id", "merge_id")


def review_queue(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("confidence") < AUTO_APPROVE)


def confirmed(candidates: DataFrame, says_yes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates of 0.95 or more, and those of the rest that ``says_yes`` keeps; without it the rest is skipped."""
    sure = candidates.where(F.col("confidence") >= AUTO_APPROVE)
    return sure.unionByName(says_yes(review_queue(candidates)).select(*sure.columns)) if says_yes else sure


_ORDER = ["at", "keep_id", "merge_id", "method"]  # the order of merges: falling confidence, then ids


def merge_order(chosen: DataFrame) -> DataFrame:
    """(keep_id, merge_id, confidence, method) of the pairs that serial merging in falling confidence would carry out.

    A pair is carried out unless an id of it was merged away by an earlier one.  In each round, pairs before which no
    open pair could merge away an id of theirs are carried out at once, and later open pairs with an id that is gone by
    that drop out; the first open pair is always among the former.  Rounds follow the longest chain of pairs that wait
    for each other, which is short unless confidences fall along a path of ids.
    """
    first = F.struct(*_ORDER)
    left = materialise(chosen.where("keep_id <> merge_id").select("keep_id", "merge_id", F.col("confidence").cast("double").alias("confidence"), F.coalesce("method", F.lit("")).alias("method"), (-F.col("confidence").cast("double")).alias("at")).distinct())
    taken = left.limit(0)
    while not left.isEmpty():
        blocks = materialise(left.groupBy("merge_id").agg(F.min(first).alias("block")))
        by = lambda c: blocks.select(F.col("merge_id").alias(c), F.col("block").alias(f"by_{c}"))
        met = left.join(by("keep_id"), "keep_id", "left").join(by("merge_id"), "merge_id")
        free = (F.col("by_merge_id") == first) & (F.col("by_keep_id").isNull() | (F.col("by_keep_id") > first))
        met = materialise(met.withColumn("free", free))
        now = met.where("free").select(*left.columns)
        gone = materialise(now.select(F.col("merge_id").alias("id"), F.struct(*_ORDER).alias("since")))
        gone_by = lambda c: gone.select(F.col("id").alias(c), F.col("since").alias(f"gone_{c}"))
        rest = met.where("not free").select(*left.columns).join(gone_by("keep_id"), "keep_id", "left").join(gone_by("merge_id"), "merge_id", "left")
        held = lambda c: F.coalesce(F.col(c) > first, F.lit(True))
        taken = taken.unionByName(now)
        left = materialise(rest.where(held("gone_keep_id") & held("gone_merge_id")).select(*left.columns))
    return materialise(taken.drop("at"))


def final_ids(taken: DataFrame) -> DataFrame:
    """``taken`` with every keep_id replaced by the id that it ends up in; chains are halved in each round."""
    links = materialise(taken.select(F.col("merge_id").alias("id"), F.col("keep_id").alias("into")))
    while True:
        on = links.select(F.col("id").alias("into"), F.col("into").alias("next"))
        links = materialise(links.join(on, "into", "left").select("id", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return taken.join(links.select(F.col("id").alias("merge_id"), "into"), "merge_id").select(F.col("into").alias("keep_id"), "merge_id", "confidence", "method")


def execute_merges(state: GraphState, chosen: DataFrame, now: int) -> GraphState:
    """Merges in falling confidence, without rows of an id that is gone by then; kept ids may be merged further on.

    Pairs of ids that the graph lacks are left out.
    """
    known = state.entities.select("id")
    real = chosen.join(known.withColumnRenamed("id", "keep_id"), "keep_id", "left_semi").join(known.withColumnRenamed("id", "merge_id"), "merge_id", "left_semi")
    return carried_out(state, merge_order(real), now)


def carried_out(state: GraphState, taken: DataFrame, now: int) -> GraphState:
    """Merges as ``merge_order`` gives them."""
    if taken.isEmpty():
        return state
    return mutations.dedup_edges(mutations.merge_entities(state, final_ids(taken), now))


def upkeep(state: GraphState, now: int, half_life_days: float = 30, prune_below: float = 0.01) -> tuple[GraphState, DataFrame]:
    """(state with decayed counts and pruned edges, count of seldom used entities)."""
    after = mutations.prune_edges(mutations.decay(state, now, half_life_days), prune_below)
    return after, low_access_count(after)


def reflect(state: GraphState, now: int, embeddings: DataFrame | None = None, full: bool = True, says_yes=None) -> GraphState:
    """A full reflection merges what is sure or confirmed and dedups edges; a light one leaves the state as it is."""
    if not full:
        return state
    found = [alias_candidates(state)] + ([vector_candidates(state, embeddings)] if embeddings is not None else [])
    return mutations.dedup_edges(execute_merges(state, confirmed(merge_candidates(*found), says_yes), now))


def synthesised(state: GraphState, entity_id: str, write: Callable[[list[str]], str], now: int, least: int = 3, most: int = 20) -> GraphState:
    """With a Background chunk about an entity of ``least`` chunks or more, written from its first ``most``."""
    texts = [r["text"] for r in temporal_chain(state, entity_id).limit(most).collect()]
    if len(texts) < least:
        return state
    spark = state.chunks.sparkSession
    row = spark.createDataFrame([(f"synthesis/{entity_id}", write(texts), [entity_id])], "source_document string, text string, tags array<string>")
    row = row.withColumns({"id": stable_id(F.col("source_document"), F.lit(now)), "chunk_type": F.lit("Background"), "memory_category": F.lit("Semantic"), "created_at": F.lit(now).cast("long"), "timestamp": F.lit(now).cast("long")})
    return mutations.store_chunks(state, row)


def similar_entities(embeddings: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(entity_id, similarity): the k nearest vectors."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    return embeddings.select("entity_id", cosine(F.col("vector"), q).alias("similarity")).orderBy(F.desc("similarity"), "entity_id").limit(k)
