"""Forms that keep shuffles and memory small, against plain counts."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from graphs import core, graph
from pyspark.sql import functions as F

from mnemoweave import schemas
from mnemoweave.operators import aggregates, relations
from mnemoweave.plans import agent, ingestion, labelling, mutations, parsing, ranking, reflection, traversal


def _edges(spark):
    """One-way, two-way and repeated edges, a self-loop, and edges of the same weight and chunk."""
    rows = [("a", "b", "c1", 1.0, "d1"), ("a", "b", "c1", 1.0, "d0"), ("b", "a", "c2", 2.0, "d1"), ("a", "b", "c3", 0.5, "d1"), ("c", "a", "c1", 1.0, "d1"), ("b", "b", "c1", 1.0, "d1")]
    return spark.createDataFrame([(s, d, c, "Discussion", "Episodic", 1, doc, w) for s, d, c, w, doc in rows], schemas.EDGES)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _shuffled_rows(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_directed_counts_fold_both_directions(spark):
    e = _edges(spark)
    got = {(r["src"], r["dst"]): r["n"] for r in aggregates.directed_counts(e).collect()}
    assert got == Counter((r["src"], r["dst"]) for r in e.collect())


def test_pair_counts_read_edges_once(spark):
    e = _edges(spark)
    expected = Counter()
    for r in e.collect():
        expected.update([(r["src"], r["dst"]), (r["dst"], r["src"])])
    found = aggregates.pair_counts(e)
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == expected
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()


def test_reweighting_takes_one_exchange(spark):
    found = aggregates.reweighted(_edges(spark))
    assert _exchanges(found) == 1
    assert sorted((r["src"], r["dst"], r["weight"]) for r in found.collect()) == [("a", "b", 3.0)] * 3 + [("b", "a", 1.0), ("b", "b", 1.0), ("c", "a", 1.0)]


def test_dedup_of_one_way_edges_and_ties(spark):
    found = aggregates.deduplicated(_edges(spark)).orderBy("src", "dst")
    assert [(r["src"], r["dst"], r["chunk_id"], r["source_document"], r["weight"]) for r in found.collect()] == [("a", "b", "c1", "d0", 2.5), ("b", "a", "c2", "d1", 2.0), ("b", "b", "c1", "d1", 1.0), ("c", "a", "c1", "d1", 1.0)]
    assert "min(" not in found.groupBy("src").agg(F.sum("weight"))._jdf.queryExecution().optimizedPlan().toString()


def test_edge_between_joins_edges_of_few_ids_unshuffled(spark):
    pairs = spark.createDataFrame([("nils berg", "KAIA HOLM"), ("Nils Berg", "Wasm"), ("Nobody", "Wasm")], "name_a string, name_b string")
    found = relations.edge_between(core(spark), pairs)
    assert {(r["name_a"], r["name_b"]): r["found"] for r in found.collect()} == {("nils berg", "KAIA HOLM"): True, ("Nils Berg", "Wasm"): False, ("Nobody", "Wasm"): False}


def test_lazy_removal_is_the_same_and_stores_less(spark):
    g, doc = core(spark), spark.createDataFrame([("plans/atlas.md",)], "document string")
    one, other = mutations.remove_documents(g, doc), mutations.remove_documents(g, doc, lazy=True)
    for name in g._fields:
        assert sorted(getattr(one.state, name).collect(), key=str) == sorted(getattr(other.state, name).collect(), key=str), name
    assert one.counts.first() == other.counts.first()


def test_links_of_equal_cosine_go_to_the_largest_id(spark):
    g = graph(spark, [("e1", "red falcon", "Project", []), ("e2", "blue falcon", "Project", [])], [])
    vectors = {"falcon": [3.0, 2.0, 5.0, 2.0], "red falcon": [8.0, 8.0, 8.0, 7.0], "blue falcon": [40.0, 40.0, 40.0, 35.0]}  # the last two differ by rounding only
    rows = spark.createDataFrame([("c1", "d", "on falcon", [("falcon", "project")])], "id string, source_document string, text string, tags array<struct<name:string,entity_type:string>>")
    assert [r["existing_id"] for r in ingestion.linked(g, rows, embed=lambda texts: [vectors[t] for t in texts]).tagged.collect()] == ["e2"]


def test_alias_merges_are_those_of_all_pairs(spark):
    draw = random.Random(7)
    named = [(f"e{i}", f"Name {i}", draw.choice("xy"), [f"a{draw.randrange(5)}"] if i < 40 else draw.sample(["b1", "b2", "b3", "b4"], draw.randrange(3))) for i in range(60)]
    g = graph(spark, named, [(f"c{k}", "d", "Decision", [f"e{i}"], 1, "") for k, i in enumerate(draw.choices(range(60), k=150))])
    key = lambda df: sorted((r["keep_id"], r["merge_id"], round(r["confidence"], 9)) for r in df.collect())
    for threshold in (0.3, 0.5):
        pairs = reflection.alias_candidates(g, threshold)
        names = {i: {n.lower(), *(x.lower() for x in a)} for i, n, _, a in named}
        kind = {i: t for i, _, t, _ in named}
        want = {(a, b) for a in names for b in names if a < b and kind[a] == kind[b] and len(names[a] & names[b]) >= threshold * len(names[a] | names[b])}
        assert sorted(tuple(sorted((r["keep_id"], r["merge_id"]))) for r in pairs.collect()) == sorted(want)
        assert key(reflection.alias_merges(g, threshold)) == key(reflection.merge_order(pairs))


def test_alias_pairs_of_one_shared_name_carry_no_names(spark, monkeypatch):
    monkeypatch.setattr(reflection, "PIECE_ROWS", 4)
    draw = random.Random(11)
    named = [(f"e{i}", f"Name {i}", draw.choice("xy"), ["one"] if i < 40 else draw.sample(["one", "b1", "b2", "b3"], draw.randrange(4))) for i in range(70)] + [("n1", "Null 1", "x", ["b1", None]), ("n2", "Null 2", "x", ["b1", None])]
    g = graph(spark, named, [(f"c{k}", "d", "Decision", [f"e{i}"], 1, "") for k, i in enumerate(draw.choices(range(70), k=150))])
    chunks = Counter(r["entity_id"] for r in g.mentions.collect())
    names, kind, want = {i: {n.lower(), *a} for i, n, _, a in named}, {i: t for i, _, t, _ in named}, []
    for a in names:
        for b in names:
            both = len(names[a] & names[b])
            if a < b and kind[a] == kind[b] and both and both / (len(names[a]) + len(names[b]) - both) >= 0.3:
                want.append(((b, a) if chunks[b] > chunks[a] else (a, b)) + (round(both / (len(names[a]) + len(names[b]) - both), 9),))
    pairs = reflection.alias_candidates(g, 0.3)
    assert sorted((r["keep_id"], r["merge_id"], round(r["confidence"], 9)) for r in pairs.collect()) == sorted(want)
    alone = pairs._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Join" in alone and "array_intersect" not in alone


def test_pagerank_shuffles_vectors_instead_of_edges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SIDE_NODES", 100, raising=False)
    monkeypatch.setattr(ranking, "PIECE_EDGES", 500, raising=False)
    draw = random.Random(3)
    rows = [(f"n{draw.randrange(300)}", f"n{draw.randrange(300)}", draw.choice((0.0, 0.5, 2.0))) for _ in range(20_000)]
    rows += [("n1", "gone", 40.0), ("gone", "n2", 40.0), ("n3", None, 9.0), (None, "n4", 9.0), ("n5", "n6", None)]
    nodes = [f"n{i}" for i in range(310)] + ["n0", None]
    before = _shuffled_rows(spark)
    got = {r["id"]: r["rank"] for r in ranking.pagerank(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(rows, "src string, dst string, weight double")).collect()}
    assert _shuffled_rows(spark) - before < len(rows)
    known = set(nodes)
    out, want = Counter(), dict.fromkeys(known, 1 / len(known))
    for s, _, w in rows:
        out[s] += w or 0
    for _ in range(20):
        given = Counter()
        for s, d, w in rows:
            if s in known and d in known and s and d and out[s] > 0:
                given[d] += want[s] * (w or 0) / out[s]
        want = {x: 0.15 / len(known) + 0.85 * given[x] for x in known}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in known) < 1e-12


def test_hashes_of_groups_go_to_python_once_for_each_block(monkeypatch):
    monkeypatch.setattr(ranking, "PIECE_EDGES", 4)
    row = lambda block, at, *arrays: pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at]), *(pa.array([None if x is None else np.array(x, t).tobytes()], pa.binary()) for x, t in zip(arrays, "qqd"))], names=["block", "at", "s", "d", "w"])
    rows = [row(1, 0, [5, 7, 9], None, None), row(1, 1, None, [2, 4], None), row(1, 2, [9, 5, 6, 7], [4, 3, 2, 2], [1, 2, 3, 4]), row(1, 2, [5, 5], [2, 9], [5, 6])]
    rows += [row(2, 1, None, [1], None), row(2, 2, [5], [1], [1]), row(3, 0, [8], None, None), row(3, 2, [8], [8], [7])]
    got = [[b.column(0)[0].as_py(), *(np.frombuffer(c[0].as_buffer(), t).tolist() for c, t in zip(b.columns[1:4], "iid")), b.column(4)[0].as_py()] for b in ranking._placed(iter(rows))]
    assert got == [[1, [0, 0, 0, 1, 2], [2, 0, 2, 0, 1], [2, 5, 6, 4, 1], 2], [3, [0], [0], [7], 0]]


def test_mentions_by_a_common_alias_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(agent, "PIECE_ENTITIES", 50, raising=False)
    named = [(f"e{i}", f"Entity {i};", "Concept", ["Common"]) for i in range(400)]
    g = graph(spark, named, [])
    texts = spark.createDataFrame([(i, f"a common one, entity {i}; and xentity 7;") for i in range(400)], "text_id int, text string")
    before = _shuffled_rows(spark)
    got = {(r["text_id"], r["id"]): r["match"] for r in agent.mentions_in(g, texts).collect()}
    assert _shuffled_rows(spark) - before < len(got) == 160_000
    assert got == {(t, f"e{i}"): 1.0 if i == t else 0.7 if i == 7 else 0.6 for t in range(400) for i in range(400)}


def test_texts_of_a_common_name_are_cut_as_its_entities(spark, monkeypatch):
    monkeypatch.setattr(agent, "PIECE_ENTITIES", 50)
    monkeypatch.setattr(agent, "PIECE_TEXTS", 50)
    hits = spark.createDataFrame([(i, "common") for i in range(400)], "text_id int, name string")
    each = spark.createDataFrame([(f"e{i}", "common") for i in range(400)], "id string, name string")
    told = spark.createDataFrame([(i, f"e{i}", "common") for i in range(400)], "text_id int, told string, name string")
    rows = agent._met(hits, each, told).collect()
    assert len({(r["text_id"], r["id"]) for r in rows}) == len(rows) == 160_000
    assert max(Counter((r["piece"], r["cut"]) for r in rows).values()) < 10_000
    assert {(r["text_id"], r["id"]) for r in rows if r["told"] and r["id"] in r["told"]} == {(i, f"e{i}") for i in range(400)}
    assert sum(r["told"] is not None for r in rows) < 40_000


def test_mentions_of_entities_of_many_names(spark):
    draw = random.Random(5)
    words = ["aab", "aabb", "bbc", "ccd", "ab", "bccd", "Dda"]
    e = [(f"e{i}", draw.choice(words), "Concept", draw.choices(words, k=draw.randrange(4))) for i in range(60)] + [("e1", "ddab", "Concept", ["aab"])]
    texts = [(draw.choice([None, *"abcdefgh"]), " ".join("".join(draw.choices(words, k=2)) if draw.random() < 0.5 else draw.choice(words) for _ in range(2))) for _ in range(30)]
    want = {}
    for t, text in texts:
        for i, own, _, aliases in e:
            for n, match in [(own.lower(), 0.7), *((a.lower(), 0.6) for a in aliases)]:
                if len(n) >= 3 and n in text.lower():
                    want[t, i] = max(want.get((t, i), 0), 1.0 if match == 0.7 and n in text.lower().split(" ") else match)
    rows = agent.mentions_in(graph(spark, e, []), spark.createDataFrame(texts, "text_id string, text string")).collect()
    assert {(r["text_id"], r["id"]): r["match"] for r in rows} == want and len(rows) == len(want)


class _Counting(labelling.RuleClient):
    """Tags that tell how many blocks of memory Python has."""

    def tag(self, texts):
        return [[(f"{i} {sys.getallocatedblocks()}", "concept") for i in range(20)] for _ in texts]


def test_tags_are_given_out_a_few_chunks_at_a_time(spark):
    chunks = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("source_document"), F.col("id").cast("int").alias("position"), F.lit("x").alias("text"))
    held = [int(r["tags"][0]["name"].split(" ")[1]) for r in labelling.tagged(chunks, _Counting()).collect()]
    assert len(held) == 4000 and max(held) - min(held) < 100_000


def test_only_texts_that_may_be_too_long_are_split_in_python(spark):
    long, odd = "One more sentence here. " * 40, "a\x1cb " * 60
    docs = spark.createDataFrame([("a", "Short text.\n\n" + long, "Episodic"), ("b", odd, "Episodic"), ("c", long.replace(". ", " "), "Episodic")], "source_document string, text string, memory_category string")
    found = parsing.parsed(docs, 100, 20)
    want = {"a": ["Short text.", *parsing.split_long(long.strip(), 100, 20)], "b": parsing.split_long(odd.strip(), 100, 20), "c": parsing.split_long(long.replace(". ", " ").strip(), 100, 20)}
    assert {k: [r["text"] for r in found.where(F.col("source_document") == k).orderBy("position").collect()] for k in want} == want and len(want["b"]) > 1
    assert "split(CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()


def test_traversal_from_few_starts_does_not_shuffle_edges(spark, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of unknown size
    edges = spark.range(20_000).select((F.col("id") % 2000).cast("string").alias("src"), ((F.col("id") * 7 + 1) % 2000).cast("string").alias("dst")).distinct()
    edges = edges.localCheckpoint()
    start = spark.createDataFrame([("5", "5"), ("9", "9")], "anchor string, id string")
    before = _shuffled_rows(spark)
    got = {(r["anchor"], r["id"], r["hop"]) for r in traversal.expand(edges, start, 2, per_anchor=True).collect()}
    assert _shuffled_rows(spark) - before < edges.count()
    to = {}
    for r in edges.collect():
        to.setdefault(r["src"], set()).add(r["dst"])
    want = set()
    for a in ("5", "9"):
        one = to[a] - {a}
        want |= {(a, a, 0), *((a, x, 1) for x in one), *((a, x, 2) for x in set().union(*(to[x] for x in one)) - one - {a})}
    assert got == want
