"""The facade, tools of an agent, and what hooks deliver."""

import json
import re
from pathlib import Path

from graphs import core
from pyspark.sql import functions as F

from mnemoweave.api import Memory
from mnemoweave.plans import embedding, evaluation, tools
from mnemoweave.sources import capture, files, snapshot


def test_memory_remembers_and_forgets(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "graph"))
    assert m.status().first()["entity_count"] == 0 and m.recall("anything") == ""
    m.remember("We decided that Ann Lee leads Falcon.", "remember://1", 100)
    m.remember("Ann Lee met Bo Chan.", "remember://2", 200)
    m.save()
    again = Memory(spark, str(tmp_path / "graph"))
    assert {r["canonical_name"] for r in again.search("ann").collect()} == {"Ann Lee"}
    assert again.mentions("Ann Lee").count() == 2 and again.evidence("Ann Lee", "Falcon").count() == 1
    assert "Falcon" in again.recall("Falcon", 5000) and "Ann Lee" in again.all_memories()
    assert again.neighbourhood("Falcon", 1)[0].count() >= 2
    again.remove_document("remember://2")
    assert again.search("Bo Chan").count() == 0
    again.forget("Falcon")
    assert again.search("falcon").count() == 0
    again.reflect(300)
    assert again.entity("Ann Lee").count() == 1


class Counting:
    """An embedder that notes what it was asked, in a file, since it runs in workers."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return embedding.hashing_embedder(texts)

    def asked(self):
        lines = Path(self.path).read_text().splitlines() if Path(self.path).exists() else []
        Path(self.path).write_text("")
        return lines


def test_vectors_are_stored_and_only_changed_entities_are_embedded(spark, tmp_path):
    embed = Counting(tmp_path / "asked")
    m = Memory(spark, str(tmp_path / "graph"), embed=embed)
    m.ingest(spark.createDataFrame([(f"d{i}", f"We decided that Person{i} leads Project{i}.", "Episodic") for i in range(4)], "source_document string, text string, memory_category string"), 100)
    embed.asked()
    m.save()
    assert len(embed.asked()) == m.state.entities.count() == 8
    m.save()
    assert embed.asked() == []
    again = Memory(spark, str(tmp_path / "graph"), embed=embed)
    assert again.vectors.count() == 8 and embed.asked() == []
    renamed = again.state.entities.withColumn("aliases", F.when(F.col("canonical_name") == "Person2", F.array(F.lit("Pea Two"))).otherwise(F.col("aliases")))
    again._changed(again.state._replace(entities=renamed))
    again.save()
    assert [x for x in embed.asked() if "Pea Two" in x] and not embed.asked()
    again.forget("Person1")
    again.save()
    left = {r["id"] for r in again.state.entities.collect()}
    assert {r["entity_id"] for r in again.vectors.collect()} == left and len(left) == 7
    assert all("Project1" in x for x in embed.asked())  # its neighbour is gone


def test_a_version_with_missing_or_cut_files_is_passed_over(spark, tmp_path):
    root = tmp_path / "graph"
    m = Memory(spark, str(root))
    for i in range(3):
        m.remember(f"We decided that Ann{i} leads Falcon{i}.", f"r://{i}", 100)
        m.save()
    names = lambda s: {r["canonical_name"] for r in s.entities.collect()}
    new, old, oldest = snapshot.versions(spark, str(root))
    assert all(snapshot.intact(spark, str(root), v, thorough=True) for v in (new, old, oldest)) and len(names(snapshot.load(spark, str(root)))) == 6
    edges = next((root / new / "edges").glob("*.parquet"))
    edges.write_bytes(edges.read_bytes()[:-40])
    assert not snapshot.intact(spark, str(root), new) and names(snapshot.load(spark, str(root))) == names(snapshot.recover(spark, str(root))) and len(names(snapshot.load(spark, str(root)))) == 4
    whole = max((root / old / "chunks").glob("*.parquet"), key=lambda f: f.stat().st_size)
    data = whole.read_bytes()
    whole.write_bytes(data.replace(b"Falcon", b"Eagles"))  # as long as before, but not the same
    assert whole.read_bytes() != data and snapshot.intact(spark, str(root), old)
    (whole.parent / f".{whole.name}.crc").unlink(missing_ok=True)
    assert len(names(snapshot.recover(spark, str(root)))) == 2
    (root / oldest / "_MANIFEST").unlink()
    assert names(snapshot.recover(spark, str(root))) == set()


def test_close_names_of_ingested_text_link_or_wait(spark, tmp_path):
    letters = lambda texts: [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    m = Memory(spark, str(tmp_path / "graph"), embed=letters)
    m.remember("We decided that Falcon Platforms starts.", "r://1", 100)
    m.remember("We decided that Eel Falcon Committee Association starts.", "r://2", 100)
    m.remember("Later we decided that Falcon Platform stops and Committee Association too.", "r://3", 200)
    names = {r["canonical_name"] for r in m.state.entities.collect()}
    assert "Falcon Platform" not in names and m.mentions("Falcon Platforms").count() == 2
    review = m.review.collect()
    assert [r["name"] for r in review] == ["Committee Association"] and 0.70 <= review[0]["similarity"] < 0.85 or "Committee Association" not in names


def test_sessions_are_ingested_and_reingested(spark, tmp_path):
    (tmp_path / "s").mkdir()
    line = lambda kind, text, i: json.dumps({"type": kind, "sessionId": "abc", "cwd": "/home/x/proj", "timestamp": f"2024-01-0{i}T00:00:00Z", "message": {"content": text}})
    (tmp_path / "s/one.jsonl").write_text("\n".join([line("user", "We decided that Ann Lee leads Falcon.", 1), line("assistant", "Agreed, Ann Lee it is.", 2)]))
    m = Memory(spark, str(tmp_path / "graph"))
    done = m.ingest_sessions(str(tmp_path / "s"), 100).collect()
    assert [(r["source_document"], r["status"], r["chunks"]) for r in done] == [("claude-session://proj/abc", "complete", 1)]
    assert m.ingest_sessions(str(tmp_path / "s"), 200).count() == 0
    docs = files.inline(spark, "We decided that Bo Chan leads Falcon.", "r://1")
    m.ingest(docs, 300)
    assert m.ingest(docs, 400).count() == 0
    before = m.state.chunks.count()
    assert m.reingest(docs, 500).count() == 1 and m.state.chunks.count() == before


def test_lore_is_ingested_once_and_searched(spark, tmp_path):
    (tmp_path / "lore.json").write_text(json.dumps(["We decided that Ann Lee leads Falcon.", "The blue door is locked."]))
    m = Memory(spark, str(tmp_path / "graph"))
    assert m.ingest_lore(str(tmp_path / "lore.json"), 100).count() == 2
    assert m.ingest_lore(str(tmp_path / "lore.json"), 200).count() == 0
    assert [r["source_document"] for r in m.lore("which door is blue", 1).collect()] == ["lore://entry/1"]
    (tmp_path / "lore.json").write_text(json.dumps(["We decided that Ann Lee leads Falcon.", "The red door is open."]))
    assert m.ingest_lore(str(tmp_path / "lore.json"), 300).count() == 1 and m.state.chunks.where("text like '%blue%'").count() == 0


def test_reports_and_json_of_a_part(spark, tmp_path):
    results = [{"name": "precision", "score": 0.5, "baseline_score": 0.4, "error": None}, {"name": "recall", "score": 0.5, "baseline_score": 0.505, "error": None}, {"name": "bad", "error": "division"}]
    text = evaluation.report_text(results, {"documents": 3})
    assert "graph ahead in 1 of 2" in text and "- bad: division" in text and text.startswith("3 documents")
    snapshot.write_text(spark, str(tmp_path), "report.json", evaluation.report_json(results, {"documents": 3}, 7))
    assert json.loads((tmp_path / "report.json").read_text())["metrics"][0]["name"] == "precision"
    rows = [(r["kind"], json.loads(r["json"])) for r in snapshot.subgraph_json(core(spark), ["e-nils", "e-atlas"]).collect()]
    assert {x["id"] for k, x in rows if k == "entities"} == {"e-nils", "e-atlas"} and any(k == "edges" for k, _ in rows)


def test_context_of_a_situation(spark):
    """Brief: entities named or similar, relations, open items; full: events too; time bounds the edges that lead to them."""
    from pyspark.sql import functions as F

    from mnemoweave.plans import agent, retrieval

    g = core(spark)
    ranks = g.entities.select("id", F.lit(0.25).alias("rank"))
    vectors = spark.createDataFrame([("e-nils", [1.0, 0.0]), ("e-kaia", [0.0, 1.0]), ("e-atlas", [0.6, 0.8])], "entity_id string, vector array<double>")
    brief = agent.context(g, vectors, ranks, "Ask Nils Berg about Wasm", [1.0, 0.0], entities=3)
    assert {r["id"]: round(r["score"], 2) for r in brief.entities.collect()} == {"e-nils": 1.3, "e-atlas": 0.6, "e-wasm": 0.3}
    assert [(r["a"], r["b"]) for r in brief.relationships.orderBy("a", "b").collect()] == [("e-atlas", "e-nils"), ("e-atlas", "e-wasm")]
    assert {r["id"] for r in brief.pending.collect()} == {"c1", "c3"} and brief.events.count() == 0
    full = agent.context(g, vectors, ranks, "Wasm", [0.0, 0.0], full=True, entities=1)
    assert {r["id"] for r in full.entities.collect()} == {"e-wasm"} and {r["id"] for r in full.events.collect()} == {"c1", "c2", "c3", "c4"}
    late = agent.context(g, vectors, ranks, "Wasm", [0.0, 0.0], full=True, entities=1, since=1_900_000_000)
    assert {r["id"] for r in late.events.collect()} == {"c4"}
    text = agent.injection_text(full)
    assert "## Recent Events" in text and "importance 1.00" in text and len(re.findall(r"(?m)^- (?:\d{4}-\d\d-\d\d|undated) \[", text)) == full.pending.count() + 4
    assert "Nils Berg" in agent.injection_text(brief) and "Recent Events" not in agent.injection_text(brief)
    start = g.entities.where("id = 'e-nils'").select("id")
    reached = lambda since: {r["id"] for r in retrieval.expanded(g, start, 1, 10, since).entities.collect()}
    assert reached(None) == {"e-nils", "e-kaia", "e-atlas"} and reached(1_900_000_000) == {"e-nils"}


def test_answers_are_read():
    known = ("timeline", "evidence")
    a = tools.read_answer("< think >why</think>Text <action>timeline('Ann', 3)</action><action>evidence(a, 'b')", known)
    assert (a.thoughts, a.text) == ("why", "Text") and a.calls == [("timeline", ["Ann", 3]), ("evidence", ["b"])]
    assert tools.read_answer("I use timeline('x') now", known).calls == [("timeline", ["x"])]
    assert tools.read_answer("<action>nonsense</action>", known).calls == [] and tools.call_of("graph_status()") == ("graph_status", [])
    assert tools.context_budget("m-large-2", {"m": 10, "m-large": 1000}) == 600 and tools.context_budget("z", {}) == 60_000


def test_an_agent_runs_tools(spark):
    g = core(spark)
    t = tools.Tools(g, g.entities.select("id", F.lit(0.25).alias("rank")))
    assert "entity_count=4" in t.run(tools.Call("graph_status", [])) and t.run(tools.Call("nope", [])).startswith("unknown")
    assert "c1" in t.run(tools.Call("evidence", ["Nils Berg", "Atlas Migration"])) and t.run(tools.Call("evidence", ["x"])).startswith("wrong")
    replies = iter(["<action>entity_mentions('Nils Berg')</action>", "Done."])
    seen = []
    assert tools.converse(lambda m: seen.append(m[-1]["content"]) or next(replies), t, "?") == "Done." and "c1" in seen[1]


def test_event_messages(spark):
    shapes = [
        {"conversation": {"messages": [{"role": "user", "text": "a"}, {"role": "x", "content": "b"}, {"role": "assistant", "content": ["c", {"text": "d"}]}]}},
        {"messages": [{"type": "user", "body": "e"}, {"role": "user", "text": "  "}]}, {"transcript": [{"text": "f"}]}, {"output": "g"}, {}, {"output": " "},
    ]
    rows = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "i int, e string").select("i", capture.transcript(capture.messages(F.col("e"))).alias("t")).orderBy("i")
    assert [r["t"] for r in rows.collect()] == ["User: a\n\nx: b\n\nAssistant: c\nd", "User: e", "unknown: f", "Assistant: g", "", ""]


def test_overflow_and_archive(spark, tmp_path):
    path = capture.write_overflow(str(tmp_path), "s", "t", 5)
    assert capture.write_overflow(str(tmp_path), "s", "t", 5) == path and len(list(tmp_path.glob("*"))) == 1
    assert [(r["source_id"], r["status"]) for r in capture.routed(files.overflow(spark, str(tmp_path))).collect()] == [("s", "processed")]
    copy = capture.archive_transcript(path, str(tmp_path / "archive"), "one")
    assert Path(copy).read_text() == Path(path).read_text()
