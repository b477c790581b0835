"""Prefix trie of conversations: succinct level-order tries for each prefix shard, heavy upper levels merged apart.

A node is a distinct sequence of first turns (role, text); its key is its depth and 128 bits, the xor of a hash of every
turn with its position.  A node with many members is an upper one, and so are its ancestors.  Below them, a node with an
upper parent starts a prefix shard, whose members are bounded.  A task lays the nodes of its shards in level order and
builds a LOUDS forest with numpy: a bit vector with a 1 for each child and a 0 to end each node, beside arrays of labels
and values.  Parents follow from the bits; going back through the levels, ``np.add.at`` sums leaves and tokens upwards.
Upper nodes are merged by Spark: what hangs below a node is summed to it first; then, for each upper node, the path of
its smallest member is added from its end to the root, in running totals.  Shards of very many nodes, as two very long
conversations would make, are merged like upper nodes.  Below the first node with one member there is a single path, and
nothing is to be summed.

Turns are ordered by turn (null first), role and text; a null role or text is empty, a row without conv_id is no turn.
Rows that repeat are turns of their own.  Donors of rebuilt conversations follow ``conv_id - conv_id % 20`` with the sign
of SQL's remainder.  Extra columns take no part.  An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import runs, sql_crc, stored, table
from mnemoweave.llm.ordered import running_totals

UPPER_MEMBERS = 1024  # a node with more members is an upper one
SHARD_NODES = 32_768  # a shard with more nodes is merged like upper nodes
PATH_BLOCK = 65_536  # turns of a conversation that are put together at once
DIGEST_IDS = 65_536  # ids of a node that are written together
DONOR_STEP, HEADS = 20, 4
_KEY = ["depth", "key_a", "key_b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_a, turn_b, words, position): turns in order, counted from 1, by a hash of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        *[F.xxhash64(F.lit(salt), role, text).alias(c) for salt, c in ((1, "turn_a"), (2, "turn_b"))],
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    short = F.length("role") <= 16  # a role that the first of these columns shows whole
    ranges = [F.col("turn"), F.substring("role", 1, 16), F.when(short, F.concat(F.lit("a"), F.substring("text", 1, 32))).otherwise(F.lit("b"))]
    return running_totals(rows, ["turn", "role", "text"], key="conv_id", ranges=ranges, keep=["conv_id", "turn_a", "turn_b", "words"]).withColumnRenamed("_total", "position")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as their donor: (conv_id, turn_a, turn_b, words, position) and all (conv_id, length)."""
    head = turns.where((F.col("conv_id") % DONOR_STEP == 0) & (F.col("position") < HEADS)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "turn_a", "turn_b", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("position").alias("own")).withColumn("asked", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    convs = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % DONOR_STEP).join(head.withColumnRenamed("conv_id", "donor"), "donor", "left")
    convs = stored(convs.select("conv_id", "own", "asked", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("asked")).alias("head")))
    given = convs.select("conv_id", F.explode("head").alias("h")).select("conv_id", "h.turn_a", "h.turn_b", "h.words", "h.position")
    asked = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    short = convs.where(F.size("head") < F.col("asked")).select("conv_id", (F.col("asked") - F.size("head")).alias("less"))
    rest = turns.where(F.col("position") > asked).join(short, "conv_id", "left").withColumn("position", F.col("position") - F.coalesce("less", F.lit(0)))
    lengths = convs.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("asked"), F.lit(0))).alias("length"))
    return given.unionByName(rest.drop("less")), lengths


def paths(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, key_a, key_b, up_a, up_b, words): the node that each turn leads to, and its parent's key."""
    marked = turns.select("conv_id", F.col("position").alias("depth"), "words", *[F.xxhash64(F.lit(salt), "position", "turn_a", "turn_b").alias(c) for salt, c in ((1, "own_a"), (2, "own_b"))])
    marked = marked.withColumn("block", F.expr(f"(depth - 1) div {PATH_BLOCK}"))
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumns({"key_a": F.bit_xor("own_a").over(along), "key_b": F.bit_xor("own_b").over(along)})
    if longest > PATH_BLOCK:
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = marked.groupBy("conv_id", "block").agg(F.bit_xor("own_a").alias("a"), F.bit_xor("own_b").alias("b"))
        sums = sums.select("conv_id", "block", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b")).where("block > 0")
        rows = rows.join(stored(sums), ["conv_id", "block"], "left").withColumns({k: F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0))) for k, c in (("key_a", "a"), ("key_b", "b"))})
    return rows.select("conv_id", *_KEY, F.col("key_a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("key_b").bitwiseXOR(F.col("own_b")).alias("up_b"), "words")


def nodes(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every node with its smallest member ``conv_id``, its members, those that end there, and what its parent is."""
    ends = path.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("k")).select("conv_id", "k.*")
    none = lambda c: F.lit(None).cast("long").alias(c)
    both = path.withColumns({"member": F.lit(1), "end": F.lit(0)}).unionByName(ends.select("*", none("up_a"), none("up_b"), none("words"), F.lit(0).alias("member"), F.lit(1).alias("end")))
    found = both.groupBy(*_KEY).agg(F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), F.sum("member").alias("n_convs"), F.sum("end").alias("n_ends"), F.max("words").alias("words"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("length") == 0, 1)).alias("n_ends")).where("n_convs > 0")
    found = stored(found.unionByName(top.select(zero("depth"), zero("key_a"), zero("key_b"), none("up_a"), none("up_b"), "conv_id", "n_convs", "n_ends", zero("words"))))
    shared = found.where("n_convs > 1 or depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), _is_upper().alias("upper_parent"))
    return stored(found.join(shared, ["depth", "up_a", "up_b"], "left").withColumn("upper", _is_upper()))


def _is_upper() -> Column:
    return (F.col("n_convs") > UPPER_MEMBERS) | (F.col("depth") == 0)


_FOREST = {"depth": "long", "key_a": "long", "key_b": "long", "conv_id": "long", "parent_conv_id": "long", "n_convs": "long", "n_ends": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long"}
_TRIES = "roots long, louds binary, label_a array<long>, label_b array<long>, " + ", ".join(f"{c} array<{t}>" for c, t in _FOREST.items())


def _level_order(level: np.ndarray, parent: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes by level, within it by their parents' order, then by label; and where each level begins."""
    rank, order, starts, done = np.zeros(len(level), np.int64), [], [0], 0
    by_level = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[by_level])) + 1
    for mine in np.split(by_level, cuts):
        above = rank[parent[mine]] if done else np.zeros(len(mine), np.int64)
        mine = mine[np.lexsort((second[mine], first[mine], above))]
        rank[mine] = done + np.arange(len(mine))
        done += len(mine)
        order.append(mine)
        starts.append(done)
    return np.concatenate(order), np.array(starts)


def forest(cols: dict[str, np.ndarray]) -> dict:
    """The LOUDS forest of whole shards, with every node's children, leaves and saved tokens.

    ``cols`` has the columns of nodes, and ``shard_depth``, the depth of the node that starts its shard.
    """
    n, level = len(cols["depth"]), cols["depth"] - cols["shard_depth"]
    # each node's parent: keys of nodes and wanted keys are sorted together, and the last node before a wanted key has it
    a, b = np.concatenate([cols["key_a"], cols["up_a"]]), np.concatenate([cols["key_b"], cols["up_b"]])
    mixed = np.lexsort((np.arange(2 * n) >= n, b, a))
    last = np.maximum.accumulate(np.where(mixed < n, np.arange(2 * n), -1))
    parent = np.empty(n, np.int64)
    parent[mixed[mixed >= n] - n] = mixed[np.maximum(last[mixed >= n], 0)]
    label_a, label_b = cols["key_a"] ^ cols["up_a"], cols["key_b"] ^ cols["up_b"]
    order, starts = _level_order(level, parent, label_a, label_b)
    cols = {k: v[order] for k, v in cols.items()}
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    roots = int(starts[1])
    children = np.bincount(place[parent[order[roots:]]], minlength=n)
    bits = np.ones(roots + 1 + n + n - roots, bool)  # a root above the roots of shards, then every node: its children, and a 0
    bits[np.append(roots, roots + 1 + np.cumsum(children) + np.arange(n))] = False
    ones = np.flatnonzero(bits)
    up = (ones - np.arange(n) - 1)[roots:]  # zeros before a node's 1, less the one of the root above
    single = cols["n_convs"] == 1  # only the first node of a path of one member is here
    leaves = np.where(single | (children == 0), 1, 0).astype(np.int64)
    saved = (cols["n_convs"] - 1) * cols["words"]
    for start, end in zip(starts[-2:0:-1], starts[:1:-1]):
        above = up[start - roots : end - roots]
        np.add.at(leaves, above, leaves[start:end])
        np.add.at(saved, above, saved[start:end])
    parent_conv = cols["parent_conv_id"].copy()
    parent_conv[roots:] = cols["conv_id"][up]
    out = {k: cols[k] for k in ("depth", "key_a", "key_b", "conv_id", "n_convs", "n_ends")}
    out |= {"parent_conv_id": parent_conv, "n_children": np.where(single, 1 - cols["n_ends"], children), "n_leaves": leaves, "saved_tokens": saved}
    return out | {"roots": roots, "louds": np.packbits(bits).tobytes(), "label_a": label_a[order], "label_b": label_b[order]}


_SHARD = ["shard_depth", "shard_a", "shard_b"]
_IN_SHARD = [*_SHARD, *_KEY, "up_a", "up_b", "conv_id", "parent_conv_id", "n_convs", "n_ends", "words"]


def tries(shards: DataFrame) -> DataFrame:
    """A LOUDS forest for each run of prefix shards that a task meets; values are arrays in level order."""
    fields = [f.strip().split(" ") for f in _TRIES.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, 3, 1 << 62):  # a shard is bounded
            made = forest(dict(zip(_IN_SHARD, found)))
            yield pa.RecordBatch.from_arrays([pa.array([made[name]], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])

    laid = shards.select(*_IN_SHARD).repartition(*_SHARD).sortWithinPartitions(*_SHARD)
    return laid.mapInArrow(build, _TRIES)


def trie_nodes(made: DataFrame) -> DataFrame:
    """The nodes of stored forests, one row each."""
    return made.select(F.explode(F.arrays_zip(*_FOREST)).alias("x")).select("x.*")


def _upper_sums(upper: DataFrame, below: DataFrame, path: DataFrame) -> DataFrame:
    """(key, n_children, n_leaves, saved_tokens) of upper nodes.  ``below`` has (key of the parent, leaves, saved) of nodes under upper ones."""
    hung = below.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    own = upper.join(hung, _KEY, "left").na.fill(0, ["n_children", "leaves", "saved"])
    own = own.withColumns({"leaves": F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")})
    own = stored(own.select(*_KEY, "conv_id", "n_children", "leaves", "saved"))
    members = own.select("conv_id").distinct()
    along = path.select("conv_id", *_KEY).join(members, "conv_id", "left_semi").unionByName(members.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _KEY]))
    mine = F.col("conv_id") == F.col("first")
    along = along.join(own.withColumnRenamed("conv_id", "first"), _KEY).select("conv_id", *_KEY, *[F.when(mine, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("leaves", "saved")])
    for c in ("leaves", "saved"):  # from the end of a path to the root
        along = running_totals(along, [F.desc("depth")], key="conv_id", weight=c).drop(c).withColumnRenamed("_total", f"{c}_up" if c == "leaves" else "saved_up")
    sums = along.groupBy(*_KEY).agg(F.sum("leaves_up").alias("n_leaves"), F.sum("saved_up").alias("saved_tokens"))
    return own.select(*_KEY, "n_children").join(sums, _KEY)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end: ids are written out in sorted ranges, then hashed block after block."""
    at = [*_KEY, "conv_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, a, b, ids = (batch.column(i).to_numpy() for i in range(4))
            start = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            start = np.union1d(start, np.arange(0, len(ids), DIGEST_IDS))
            text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(start, np.append(start[1:], len(ids)))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[start]) for c in (d, a, b, ids)], pa.array(text)], names=[*at, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *mine, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if mine == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = mine, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*_KEY, "ends_sha256"])

    blocks = ends.select(*at).repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(write, ", ".join(f"{c} long" for c in at) + ", ids string")
    return blocks.repartition(*_KEY).sortWithinPartitions(*at).mapInArrow(digest, ", ".join(f"{c} long" for c in _KEY) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, in the columns of ``op11``."""
    turns, lengths = rebuilt(numbered_turns(conversations))
    path = stored(paths(turns, lengths.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]))
    every = nodes(path, lengths)

    # prefix shards: the members of a node that starts one, and the nodes whose smallest member is among them
    starts = every.where("not upper and upper_parent and n_convs > 1").select(*_KEY)
    members = path.select("conv_id", *_KEY).join(starts, _KEY).select("conv_id", *[F.col(k).alias(s) for k, s in zip(_KEY, _SHARD)])
    light = every.where("not upper and parent_conv_id is not null and not (upper_parent and n_convs = 1)")
    sharded = stored(light.join(members, "conv_id"))
    large = sharded.groupBy(*_SHARD).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD_NODES).drop("size")
    made = stored(tries(sharded.join(large, _SHARD, "left_anti")))
    low = trie_nodes(made)
    lifted = sharded.join(large, _SHARD, "left_semi")  # nodes of shards that are too large

    upper = stored(every.where("upper").select(*_KEY, "up_a", "up_b", "conv_id", "parent_conv_id", "n_convs", "n_ends", "words").unionByName(lifted.where("n_convs > 1").select(*_KEY, "up_a", "up_b", "conv_id", "parent_conv_id", "n_convs", "n_ends", "words")))
    lone = every.where("not upper and n_convs = 1 and upper_parent").select(*every.columns).unionByName(lifted.where("n_convs = 1").select(*every.columns))
    to_parent = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")]
    began = every.where("not upper and upper_parent and n_convs > 1").select(*_KEY, "up_a", "up_b")
    none = F.lit(0).cast("long")
    below = lone.select(*to_parent, F.lit(1).cast("long").alias("leaves"), none.alias("saved"))
    below = below.unionByName(low.select(*_KEY, "n_leaves", "saved_tokens").join(began, _KEY).select(*to_parent, F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    below = below.unionByName(upper.where("depth > 0").select(*to_parent, none.alias("leaves"), none.alias("saved")))
    high = upper.join(_upper_sums(upper, below, path), _KEY)

    ends = path.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("k")).select("k.*", "conv_id").unionByName(lengths.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in _KEY], "conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = F.sha2(F.when(F.col("n_ends") > 0, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256")
    several = low.where("n_convs > 1").select(*_KEY, *[c for c in columns if c != "depth"]).unionByName(high.select(*_KEY, *[c for c in columns if c != "depth"]))
    several = several.join(end_digests(ends), _KEY, "left").select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    tail = every.where("depth > 0 and parent_conv_id is null").withColumn("parent_conv_id", F.col("conv_id"))
    single = tail.unionByName(lone).withColumns({"n_children": 1 - F.col("n_ends"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": none})
    return several.unionByName(single.select(*columns, alone)).unionByName(low.where("n_convs = 1").select(*columns, alone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS i, coalesce(role, '') AS r, coalesce("text", '') AS t
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % {DONOR_STEP} AS donor, h, least(h, (SELECT count(*) FROM own o WHERE o.c = x.c - x.c % {DONOR_STEP})) AS k
  FROM (SELECT DISTINCT c, {sql_crc("CAST(c AS VARCHAR)")} % {HEADS} AS h FROM own) x
), turns AS (
  SELECT convs.c, i AS d, r, t FROM convs JOIN own ON own.c = donor AND i <= k UNION ALL SELECT convs.c, i - h + k, r, t FROM convs JOIN own ON own.c = convs.c AND i > h
), path AS (
  SELECT c, d, md5(string_agg(length(r) || ' ' || length(t) || ' ' || r || t, '') OVER (PARTITION BY c ORDER BY d)) AS k, len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs
), step AS (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM path
), node AS (
  SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM step GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (d, k)
), sums AS (
  SELECT p.d, p.k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * x.words) AS saved FROM known x JOIN path p ON p.c = x.c AND p.d <= x.d GROUP BY ALL
)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n AS n_convs, CAST(x.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM known x JOIN sums USING (d, k) LEFT JOIN node p ON p.d = x.d - 1 AND p.k = x.up
"""
