"""Operators on small literal graphs, with the decided readings of what is ambiguous."""

import random

import numpy as np
import pytest
from graphs import T0, core, graph
from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave import schemas, sqlviews
from mnemoweave.operators import aggregates, lookups, relations
from mnemoweave.plans import agent, mutations, ranking, reflection, retrieval, similarity, traversal
from mnemoweave.sources import snapshot
from mnemoweave.state import GraphState


def ids(df, column="id"):
    return {r[column] for r in df.select(column).collect()}


def test_traversal(spark):
    g = core(spark)
    assert ids(traversal.neighbourhood(g, "e-nils", 1)) == {"e-nils", "e-kaia", "e-atlas"}
    assert {r["id"]: r["hop"] for r in traversal.neighbourhood(g, "e-nils", 3).collect()} == {"e-nils": 0, "e-kaia": 1, "e-atlas": 1, "e-wasm": 2}
    assert ids(traversal.neighbourhood(g, "e-nils", 2, 1893456000)) == {"e-nils"}
    assert not ids(traversal.neighbourhood(g, "nobody", 2))
    entities, edges, chunks = traversal.subgraph(g, "e-nils", 1)
    assert ids(entities) == {"e-nils", "e-kaia", "e-atlas"} and edges.count() == 6 and ids(chunks) == {"c1", "c2", "c3", "c4"}


def test_undated_edges_are_followed_without_bounds_only(spark):
    e = lambda s, d, t: (s, d, "c", "Discussion", "Episodic", t, "doc", 1.0)
    g = graph(spark, [(x, x, "Concept", []) for x in "abc"], [("c", "doc", "Discussion", [], T0, "")], edges=[e("a", "b", T0), e("a", "c", None)])
    assert ids(traversal.neighbourhood(g, "a", 1)) == {"a", "b", "c"}
    assert ids(traversal.neighbourhood(g, "a", 1, 0)) == {"a", "b"}


def test_time_filter_bounds_traversal_not_the_result(spark):
    g = core(spark)
    _, edges, _ = traversal.subgraph(g, "e-nils", 1, T0, T0)
    assert edges.count() == 6
    assert traversal.subgraph(g, "e-nils", 1, T0, T0, strict_time=True)[1].count() == 6
    _, edges, chunks = traversal.subgraph(g, "e-nils", 1, T0 + 1)
    assert edges.count() == 0 and ids(chunks) == {"c1", "c2"}


def test_temporal_chain_ascends_and_falls_back_to_tags(spark):
    g = graph(spark, [("a", "A", "Concept", [])], [(f"c{t}", "d", "Discussion", ["a"], t, "") for t in (3000, 1000, 2000)])
    assert [r["id"] for r in relations.temporal_chain(g, "a").collect()] == ["c1000", "c2000", "c3000"]
    bare = g._replace(mentions=g.mentions.limit(0))
    assert [r["id"] for r in relations.temporal_chain(bare, "a").collect()] == ["c1000", "c2000", "c3000"]
    dangling = g._replace(mentions=spark.createDataFrame([("a", "gone"), ("a", "c1000")], schemas.MENTIONS))
    assert [r["id"] for r in relations.temporal_chain(dangling, "a").collect()] == ["c1000"]
    assert [r["id"] for r in agent.timeline(g, "a", 2).collect()] == ["c2000", "c3000"]
    assert [r["id"] for r in agent.mentions(g, "a", 2).collect()] == ["c3000", "c2000"]


def test_time_window(spark):
    g = graph(spark, [], [(str(t), "d", "Discussion", [], t, "") for t in (100, 200, 300)] + [("none", "d", "Discussion", [], None, "")])
    n = lambda *a: lookups.chunks_in_window(g, *a).count()
    assert (n(100, 200), n(None, 200), n(200), n()) == (2, 2, 2, 3)


def test_search_and_resolve(spark):
    g = graph(spark, [("1", "Nils Berg", "Person", ["NB"]), ("2", "Kaia Berg", "Person", ["NB2"]), ("3", "Rust", "Technology", [])], [])
    assert [ids(lookups.search_entities(g, q)) for q in ("berg", "rust", "xyz", "nb")] == [{"1", "2"}, {"3"}, set(), {"1", "2"}]
    assert ids(lookups.resolve(g, "kaia berg")) == {"2"} and ids(lookups.resolve(g, "3")) == {"3"} and ids(lookups.resolve(g, "NB2")) == {"2"}
    assert ids(lookups.lookup_by_name(g, "NB")) == {"1"}


def test_repeated_tags_pair_with_others_only(spark):
    g = graph(spark, [("x", "X", "Concept", []), ("y", "Y", "Concept", [])], [("c", "d", "Decision", ["x", "y", "x"], T0, "")])
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [("x", "y")] * 2 + [("y", "x")] * 2
    assert {r["weight"] for r in g.edges.collect()} == {2.0}


def test_pagerank_prefers_the_hub_and_keeps_mass_below_one(spark):
    g = graph(spark, [(x, x, "Concept", []) for x in ("hub", "a", "b", "c", "alone")], [(x, "d", "Discussion", ["hub", x], T0, "") for x in "abc"])
    r = {x["id"]: x["rank"] for x in ranking.pagerank(g.entities, g.edges).collect()}
    assert r["hub"] > r["a"] and sum(r.values()) <= 1 + 1e-9 and r["alone"] == pytest.approx(0.15 / 5)
    files = spark.createDataFrame([("app", "core", "Import"), ("util1", "core", "Import"), ("util2", "core", "Import"), ("app", "util1", "Import"), ("util2", "leaf", "Import")], schemas.FILE_EDGES)
    nodes = files.select(F.explode(F.array("src", "dst")).alias("id"))
    assert ranking.top_ranked(ranking.pagerank(nodes, ranking.file_edges_weighted(files)), 1).first()["id"] == "core"


def test_pagerank_of_nothing(spark):
    g = GraphState.empty(spark)
    assert ranking.pagerank(g.entities, g.edges).count() == 0


def test_reweighting_and_dedup_depend_on_their_order(spark):
    g = graph(spark, [("a", "A", "Concept", []), ("b", "B", "Concept", [])], [("c1", "d", "Discussion", ["a", "b"], 1, ""), ("c2", "d", "Decision", ["a", "b"], 2, "")])
    assert [r["weight"] for r in aggregates.reweighted(g.edges).collect()] == [2.0] * 4
    once = aggregates.deduplicated(g.edges).orderBy("src").collect()
    assert [(r["src"], r["chunk_id"], r["weight"]) for r in once] == [("a", "c2", 3.0), ("b", "c2", 3.0)]
    assert {r["weight"] for r in aggregates.reweighted(aggregates.deduplicated(g.edges)).collect()} == {1.0}


def test_decay_compounds(spark):
    g = core(spark)
    g = g._replace(entities=g.entities.withColumns({"access_count": F.lit(100).cast("long"), "updated_at": F.lit(0).cast("long")}))
    once = mutations.decay(g, 30 * 86400)
    assert {r["access_count"] for r in once.entities.collect()} == {50}
    assert {r["access_count"] for r in mutations.decay(once, 30 * 86400).entities.collect()} == {25}


def test_merge_unites_and_redirects(spark):
    g = core(spark)
    m = mutations.merge_entities(g, spark.createDataFrame([("e-nils", "e-kaia", None, None)], "keep_id string, merge_id string, confidence double, method string"), 9)
    nils = m.entities.where("id = 'e-nils'").first()
    assert nils["aliases"] == ["NB", "Kaia Holm"] and nils["access_count"] == 2 and nils["updated_at"] == 9
    assert (nils["merge_history"][0]["method"], nils["merge_history"][0]["confidence"]) == ("direct", 0.0)
    assert sorted((r["src"], r["dst"], r["chunk_id"]) for r in m.edges.where("src = 'e-nils'").collect()) == [("e-nils", "e-atlas", "c1"), ("e-nils", "e-atlas", "c3")]
    assert m.chunks.where("id = 'c2'").first()["tags"] == ["e-nils", "e-nils"]
    assert ids(m.mentions.where("entity_id = 'e-nils'"), "chunk_id") == {"c1", "c2", "c3"}
    again = mutations.merge_entities(m, spark.createDataFrame([("e-nils", "e-kaia", None, None)], "keep_id string, merge_id string, confidence double, method string"), 10)
    assert again.entities.where("id = 'e-nils'").first()["updated_at"] == 9


def test_alias_candidates_need_one_type_and_enough_overlap(spark):
    g = graph(spark, [("j", "Nils Berg", "Person", ["NB"]), ("k", "N. Berg", "Person", ["Nils Berg", "NB"]), ("p", "Nils Berg", "Project", ["NB"])], [("c1", "d", "Discussion", ["j"], 1, ""), ("c2", "d", "Discussion", ["j", "k"], 1, "")])
    found = reflection.alias_candidates(g, 0.3).collect()
    assert [(r["keep_id"], r["merge_id"]) for r in found] == [("j", "k")] and found[0]["confidence"] == pytest.approx(2 / 3)
    assert reflection.alias_candidates(g).count() == 0


def test_merges_follow_chains(spark):
    g = graph(spark, [(x, x, "Concept", []) for x in "abcd"], [])
    rows = spark.createDataFrame([("a", "b", 0.99, "m"), ("c", "a", 0.98, "m"), ("b", "d", 0.97, "m")], "keep_id string, merge_id string, confidence double, method string")
    after = reflection.execute_merges(g, rows, 5)
    assert ids(after.entities) == {"c", "d"}
    assert {h["merged_entity_id"] for h in after.entities.where("id = 'c'").first()["merge_history"]} == {"a", "b"}


def _serial(pairs):
    """Kept ids of merged ones, by going through pairs one after the other."""
    into = {}
    for keep, merge, _, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1], p[3])):
        if keep != merge and keep not in into and merge not in into:
            into[merge] = keep

    def last(i):
        return last(into[i]) if i in into else i

    return {m: last(k) for m, k in into.items()}


@pytest.mark.parametrize("seed", range(4))
def test_merges_by_rounds_equal_serial_ones(spark, seed):
    r = random.Random(seed)
    n = 12 + 20 * seed
    pairs = [(f"e{r.randrange(n)}", f"e{r.randrange(n)}", r.choice([0.9, 0.95, 1.0, round(r.random(), 2)]), r.choice("xy")) for _ in range(3 * n)]
    pairs += [("e0", f"e{i}", 0.99, "hub") for i in range(n)] if seed == 3 else []
    taken = reflection.merge_order(spark.createDataFrame(pairs + pairs[:3], "keep_id string, merge_id string, confidence double, method string"))
    assert {x["merge_id"]: x["keep_id"] for x in reflection.final_ids(taken).collect()} == _serial(pairs)


def test_merges_leave_out_pairs_of_unknown_ids(spark):
    g = graph(spark, [(x, x, "Concept", []) for x in "abcdefgh"], [])
    pairs = [("a", "b", 1.0, "m"), ("a", "c", 1.0, "m"), ("b", "c", 1.0, "m"), ("zz", "e", 1.0, "m"), ("e", "f", 0.99, "m"), ("d", "a", 0.98, "m"), ("c", "g", 0.97, "m"), ("h", "h", 0.96, None)]
    after = reflection.execute_merges(g, spark.createDataFrame(pairs, "keep_id string, merge_id string, confidence double, method string"), 5)
    assert ids(after.entities) == {"d", "e", "g", "h"}
    assert {h["merged_entity_id"] for h in after.entities.where("id = 'd'").first()["merge_history"]} == {"a", "b", "c"}
    assert ids(reflection.execute_merges(g, spark.createDataFrame([], "keep_id string, merge_id string, confidence double, method string"), 5).entities) == set("abcdefgh")


def _cosines(rows, threshold):
    found = {}
    for i, (a, kind, u) in enumerate(rows):
        for b, other, v in rows[i + 1 :]:
            if kind == other and u and v and np.linalg.norm(u) and np.linalg.norm(v):
                s = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                if s >= threshold:
                    found[tuple(sorted((a, b)))] = s
    return found


@pytest.mark.parametrize("blocks", [(1, 1000), (4, 7), (16, 3)])
def test_exact_vector_pairs_are_all_pairs(spark, blocks):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8))
    rows = [(f"v{i}", f"k{i % 3}", (centres[i % 6] + 0.35 * rng.standard_normal(8)).tolist()) for i in range(150)]
    rows += [("copy1", "k0", rows[0][2]), ("copy2", "k0", rows[0][2]), ("zero", "k0", [0.0] * 8), ("none", "k0", None), ("other", "k0", [1.0] * 3)]
    frame = spark.createDataFrame(rows, "id string, kind string, vector array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.exact_pairs(frame, 0.8, *blocks).collect()}
    want = _cosines(rows[:-3], 0.8)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert similarity.exact_pairs(frame.limit(0), 0.8).count() == similarity.hashed_pairs(frame.limit(0), 0.8).count() == 0


def test_hashed_vector_pairs_miss_few_and_do_not_pair_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 32))
    near = base + 0.28 * rng.standard_normal((400, 32))
    rows = [(f"a{i}", "k", v.tolist()) for i, v in enumerate(base)] + [(f"b{i}", "k", v.tolist()) for i, v in enumerate(near)]
    rows += [(f"c{i}", "k", base[0].tolist()) for i in range(300)]
    got = similarity.hashed_pairs(spark.createDataFrame(rows, "id string, kind string, vector array<double>"), 0.9).collect()
    want = _cosines(rows[:800], 0.9)
    found = {(r["a"], r["b"]) for r in got if not r["b"].startswith("c")}
    assert len(want) > 300 and len(found & want.keys()) >= 0.97 * len(want) and found <= want.keys()
    assert {(r["a"], r["b"]) for r in got if r["b"].startswith("c")} == {("a0", f"c{i}") for i in range(300)}
    planes, tables = similarity.tables_for(100_000_000, 0.9)
    assert tables < 400 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** planes) ** tables >= 0.99


def test_lookups_in_sql(spark):
    names = sqlviews.register(spark, core(spark), "kg_")
    assert {"kg_entities", "kg_cooccurrences_of"} <= set(names)
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert rows("SELECT id FROM kg_entities_named('nils berg')") == [("e-nils",)]
    near = {r["neighbor"]: r["n"] for r in spark.sql("SELECT * FROM kg_cooccurrences_of('e-nils')").collect()}
    assert near == {r["id"]: r["count"] for r in relations.neighbour_counts(core(spark), "e-nils").collect()}
    assert rows("SELECT e.id, c.neighbor FROM kg_entities e, LATERAL kg_cooccurrences_of(e.id) c WHERE e.id = 'e-wasm'") == [("e-wasm", n) for (n,) in rows("SELECT neighbor FROM kg_cooccurrences_of('e-wasm')")]
    assert rows("SELECT chunk_id FROM kg_evidence_between('e-nils', 'e-kaia')") == rows("SELECT chunk_id FROM kg_evidence_between('e-kaia', 'e-nils')") != []
    assert len(rows("SELECT id FROM kg_chunks_of('e-nils')")) == relations.temporal_chain(core(spark), "e-nils").count()


def test_document_removal_keeps_entities_that_live_elsewhere(spark):
    g = core(spark)
    doc = spark.createDataFrame([("plans/atlas.md",)], "document string")
    r = mutations.remove_documents(g, doc)
    assert r.counts.first().asDict() == {"chunks_removed": 1, "edges_removed": 2, "entities_removed": 1, "entities_updated": 1}
    assert ids(r.state.entities) == {"e-nils", "e-kaia", "e-atlas"}


def test_orphans_go_when_old(spark):
    g = graph(spark, [("a", "A", "Concept", []), ("b", "B", "Concept", []), ("o", "O", "Concept", [])], [("c", "d", "Discussion", ["a", "b"], 1, "")])
    assert ids(relations.orphans(g)) == {"o"}
    assert ids(mutations.cleanup_orphans(g, 200).entities) == {"a", "b", "o"}
    assert ids(mutations.cleanup_orphans(g, 100 + 8 * 86400).entities) == {"a", "b"}


def test_snapshots_rotate_and_refuse_to_empty(spark, tmp_path):
    root, g = str(tmp_path), core(spark)
    saved = [snapshot.save(spark, g, root) for _ in range(5)]
    assert snapshot.versions(spark, root) == saved[:0:-1]
    assert ids(snapshot.load(spark, root).entities) == ids(g.entities)
    with pytest.raises(ValueError):
        snapshot.save(spark, GraphState.empty(spark), root)
    newest = tmp_path / saved[-1] / "entities"
    for f in newest.glob("*.parquet"):
        f.write_bytes(b"broken")
        (newest / f".{f.name}.crc").unlink(missing_ok=True)
    assert ids(snapshot.recover(spark, root).entities) == ids(g.entities)
    assert snapshot.json_rows(g).where("kind = 'entities'").count() == 4


def test_context_is_budgeted(spark):
    g = core(spark)
    vectors = spark.createDataFrame([("e-nils", [1.0, 0.0]), ("e-wasm", [0.0, 1.0])], schemas.EMBEDDINGS)
    ranks = g.entities.select("id", F.lit(0.25).alias("rank"))
    text = retrieval.assembled(g, vectors, ranks, [1.0, 0.0], 5, 3000)
    assert "Nils Berg" in text and "> Nils decided" in text
    assert retrieval.assembled(g, vectors, ranks, [1.0, 0.0], 5, 900) == ""
    assert retrieval.assembled(GraphState.empty(spark), vectors.limit(0), ranks.limit(0), [1.0, 0.0], 5, 3000) == ""
    p = retrieval.adaptive(1000, 100, 1000)
    assert (p.tier1 + p.tier2 + p.tier3, p.anchors, p.hops, p.entities) == (1000, 10, 3, 40)
    assert retrieval.adaptive(5, 100, 1000).hops == 2


def test_hop_weights(spark):
    row = spark.range(5).select(X.distance_weight(F.col("id")).alias("w")).collect()
    assert [r["w"] for r in row] == [1.0, 1.0, 0.5, 0.25, 0.125]
    hops = spark.createDataFrame([("a", 2)], "id string, hop int")
    chunks = spark.createDataFrame([("c", ["a", "b"]), ("d", [])], "id string, tags array<string>")
    assert {r["id"]: r["min_hop"] for r in aggregates.hops_of_chunks(chunks, hops).collect()} == {"c": 2, "d": 99}


def test_name_mentions(spark):
    g = graph(spark, [("s", "Ines Maar", "Person", ["IM", "Inny"]), ("r", "Wasm", "Technology", []), ("x", "Go", "Technology", [])], [])
    t = spark.createDataFrame([("1", "Ines Maar and Go"), ("2", "wasmtime"), ("3", "ask Inny"), ("4", "")], "text_id string, text string")
    assert sorted((r["text_id"], r["id"], r["match"]) for r in agent.mentions_in(g, t).collect()) == [("1", "s", 1.0), ("2", "r", 0.7), ("3", "s", 0.6)]


def test_mentions_query_searches_every_text_for_every_name(spark, data):
    import re

    from mnemoweave.catalog import state_queries
    from mnemoweave.testviews import graph as tables

    e = [(r["id"], r["canonical_name"], list(r["aliases"])) for r in tables(spark, data).entities.select("id", "canonical_name", "aliases").collect()]
    want = {}
    for text_id, own, known in e:
        text = f"About {own}5 and {own}. Bought as x{known[0]}; ring, {own.split(' ')[1]}".lower()
        for i, name, aliases in e:
            for n, match in [(name.lower(), 0.7), *((a.lower(), 0.6) for a in aliases)]:
                if len(n) >= 3 and n in text:
                    whole = match == 0.7 and re.search(r"(?<!\w)" + re.escape(n) + r"(?!\w)", text)
                    want[text_id, i] = max(want.get((text_id, i), 0), 1.0 if whole else match)
    got = {(r["text_id"], r["id"]): r["match"] for r in state_queries.QUERIES["j14_mentions_in_text"][0](spark, data).collect()}
    assert got == want and len({t for t, _ in got}) == len(e) > 4


def test_a_large_budget_takes_more_than_a_thousand_lines(spark):
    lines = spark.createDataFrame([(i, "x" * 40) for i in range(1500)], "id int, line string")
    order = [F.col("id")]
    assert retrieval._budgeted(lines, order, 15_000).count("\n") == 1499
    assert retrieval._budgeted(lines, order, 12_005).count("\n") == 1199 and retrieval._budgeted(lines, order, 5) == ""


def test_prefix_budget_stops_and_greedy_packing_goes_on(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 10), ("c", 3, 4)], "id string, place int, tokens int")
    assert ids(aggregates.within_budget(rows, F.col("tokens"), 10, [F.col("place")])) == {"a"}
    from mnemoweave.plans.repo import packed

    assert packed(rows, 10).first()["ids"] == ["a", "c"]
    assert ids(aggregates.last_within_budget(rows.withColumn("g", F.lit(1)), F.col("tokens"), 1, [F.desc("place")], ["g"])) == {"c"}
