"""Prefix tries, importance resampling and sharding against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, odd
from pyspark.sql import functions as F

from mnemoweave.llm import importance, prefix_trie, sharding
from mnemoweave.llm.ordered import running_totals

TURNS = "conv_id long, turn long, role string, text string"


# running totals
def test_running_totals_go_on_across_ranges(spark):
    r = random.Random(2)
    rows = [(7 if r.random() < 0.6 else r.randrange(20), i, r.randrange(5)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k int, i long, w long").repartition(5)
    got = {(x["k"], x["i"]): x["_total"] for x in running_totals(frame, [F.desc("i")], key="k", weight="w").collect()}
    want, run = {}, Counter()
    for k, i, w in sorted(rows, key=lambda x: (x[0], -x[1])):
        run[k] += w
        want[k, i] = run[k]
    assert got == want
    assert sorted((x["i"], x["_total"]) for x in running_totals(frame, ["i"]).collect()) == [(i, i + 1) for i in range(2000)]
    assert running_totals(frame.limit(0), ["i"], key="k").count() == 0


# 11 prefix tries
def _conversations(spark):
    r = random.Random(1)
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\x0bf", "a b", "x y"])) for c in range(300) for t in range(r.randrange(0, 7))]
    rows += [(None, 1, "user", "no id")] * 2 + [(c, i, "user", f"w{i % 5} z") for c in (7000, 7001, 7020) for i in range(200)]
    rows += [(9000 + i, 0, "user", "hi") for i in range(40)] + [(-3, 1, "q", "r"), (-20, 1, "z", "z"), (-23, 1, "y", "y"), (5, 9, "user", "long " * 50_000)] + [(11, 1, "user", "twice")] * 2
    return spark.createDataFrame([(*x, 1, 2, "u") for x in rows], TURNS + ", depth long, n long, shard_a string")


def _plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in members.items())


@pytest.mark.parametrize("limits", [None, (3, 50, 16), (1, 10_000, 1000)])
def test_trie_matches_a_plain_trie(spark, monkeypatch, limits):
    if limits:
        for name, value in zip(("UPPER_MEMBERS", "SHARD_NODES", "PATH_BLOCK"), limits):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = _conversations(spark)
    got = sorted(tuple(r) for r in prefix_trie.prefix_trie(rows).collect())
    assert got == _plain_trie([tuple(r)[:4] for r in rows.collect()])


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


def test_forest_bits_name_parents():
    #      0       1
    #    2   3     4      levels in order; each node's children, then a 0
    one = lambda *x: np.array(x, np.int64)
    cols = {"depth": one(5, 2, 6, 6, 3), "shard_depth": one(5, 2, 5, 5, 2), "key_a": one(10, 11, 12, 13, 14), "key_b": one(0, 0, 1, 2, 3), "up_a": one(1, 2, 10, 10, 11), "up_b": one(9, 9, 0, 0, 0), "conv_id": one(1, 2, 1, 3, 4), "parent_conv_id": one(0, 0, -1, -1, -1), "n_convs": one(4, 2, 3, 1, 2), "n_ends": one(0, 0, 3, 1, 2), "words": one(5, 7, 2, 9, 4)}
    made = prefix_trie.forest(cols)
    bits = np.unpackbits(np.frombuffer(made["louds"], np.uint8))[: 2 * 5 + 1]
    assert made["roots"] == 2 and bits.sum() == 5
    by = {c: i for i, c in enumerate(made["key_a"].tolist())} if "key_a" in made else {}
    zeros = np.cumsum(bits == 0)[np.flatnonzero(bits)] - 1
    parent = {int(made["key_a"][i]): int(made["key_a"][zeros[i]]) if i >= 2 else None for i in range(5)}
    assert parent == {10: None, 11: None, 12: 10, 13: 10, 14: 11}
    assert [made[c][by[10]] for c in ("n_children", "n_leaves", "saved_tokens")] == [2, 2, 3 * 5 + 2 * 2]
    assert [made[c][by[11]] for c in ("n_children", "n_leaves", "saved_tokens", "parent_conv_id")] == [1, 1, 1 * 7 + 1 * 4, 0]
    assert made["parent_conv_id"][by[14]] == 2


def test_trie_sql_matches_a_plain_trie(spark):
    rows = [tuple(r)[:4] for r in _conversations(spark).where("conv_id < 7000").collect()]
    con = duckdb.connect()
    con.register("conversations", pa.table({c: pa.array(v) for c, v in zip(("conv_id", "turn", "role", "text"), zip(*rows))}))
    assert sorted(con.execute(prefix_trie.ORACLE).fetchall()) == _plain_trie(rows)


# 12 importance resampling
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain_sample(rows, target, percent=5):
    def features(text):
        w = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    found, want = [(i, *features(t)) for i, t in rows], Counter()
    for t in target:
        want += features(t)[1]
    have = sum((c for *_, c in found), Counter())
    s, t = sum(have.values()), sum(want.values())
    out = []
    for i, n, c in found:
        weight = sum(k * math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000)))) for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_sample_matches_a_plain_one(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Ab", "cd", "é", "ÉF", "x1", "Q", "zz"]) for _ in range(r.randrange(60))) + r.choice(["", ".", "\n"]) for _ in range(400)]
    both = docs(spark, texts, 100).unionByName(odd(spark).select(*docs(spark, ["x"]).columns)).unionByName(docs(spark, ["aa bb! " * 200_000, "one", "longword" * 90_000 + " end"], 900))
    target = spark.createDataFrame([("ab cd ab",), (None,), ("zz zz cd é",), ("",)], "text string")
    both = both.withColumns({"bucket": F.lit(1), "whole": F.lit("x"), "weight": F.lit(None)})
    want = _plain_sample([(x["doc_id"], x["text"]) for x in both.collect()], [x[0] for x in target.collect()], 20)
    got = sorted((tuple(x) for x in importance.resample(both, target, percent=20).collect()), key=repr)
    assert got == want and any(x[4] for x in got)


def test_sample_of_nothing(spark):
    nothing = docs(spark, ["x"]).limit(0)
    assert importance.resample(nothing, nothing.select("text")).count() == 0
    one = importance.resample(docs(spark, ["a " * 30]), nothing.select("text")).collect()
    assert [(x["n_features"], x["rank"]) for x in one] == [(87, None)]


# 13 sharding
def _sharded(frame):
    rows = frame.select("doc_id", "text").collect()
    got = sharding.shard_rows(frame).collect()
    load = Counter(x["shard"] for x in got)
    assert {x["law"] for x in got} <= {"rows"} and all(x["grown_shard"] is None for x in got)
    assert max(load.values(), default=0) - min(load[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(load[s]))
    plain = lambda i, t: (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((repr(x["doc_id"]), x["size"], x["text_crc32"]) for x in got) == Counter(plain(*x) for x in rows)
    text, where, n = dict(map(tuple, rows)), defaultdict(set), Counter()
    for x in got:
        where[text[x["doc_id"]]].add(x["shard"])
        n[text[x["doc_id"]]] += 1
    return {t: (n[t], len(where[t])) for t in n if t is not None}


def test_equal_texts_share_a_shard(spark):
    r = random.Random(3)
    found = _sharded(docs(spark, [f"group {r.randrange(120)}" if r.random() < 0.4 else f"alone {i}" for i in range(1500)]))
    assert all(shards == 1 for _, shards in found.values())


def test_a_text_of_a_third_of_the_rows_is_cut_little(spark):
    r = random.Random(3)
    found = _sharded(docs(spark, ["hot" if i % 3 == 0 else f"group {r.randrange(200)}" for i in range(2000)]))
    assert found["hot"][1] <= 5  # 667 rows, 250 places in a shard
    assert sum(shards > 1 for _, shards in found.values()) <= 16


def test_shards_of_odd_rows(spark):
    _sharded(odd(spark).withColumns({"shard": F.lit("x"), "n": F.lit(1), "hub_a": F.lit(None)}))
    _sharded(docs(spark, ["same"] * 13))
    assert sharding.shard_rows(docs(spark, ["x"]).limit(0)).count() == 0
