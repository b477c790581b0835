"""Scalars, parsing, sessions, model answers, ingestion, evaluation."""

import json
import subprocess

import pytest
from graphs import core
from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave.plans import conversations, evaluation, ingestion, labelling, parsing
from mnemoweave.sources import files
from mnemoweave.state import GraphState

D = 86400


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, X.path_stem(lit("a/b.c.md")), X.path_stem(lit(".env")), X.basename(lit("a/b")), X.module_name(lit("src/a/__init__.py")), X.module_name(lit("lib/x/y.py"))) == ("b.c", ".env", "b", "a", "x.y")
    assert one(spark, X.token_estimate(lit("a b c")), X.token_estimate(lit(""))) == (3, 0)
    assert one(spark, X.shortened(lit("x" * 201)), X.quoted(lit("a\nb"))) == ("x" * 197 + "...", "> a\n> b")
    assert one(spark, X.stars(lit(0.0), lit(0.0)), X.stars(lit(1.0), lit(1.0)), X.stars(lit(0.5), lit(1.0))) == ("★", "★" * 5, "★★★")
    assert one(spark, X.day(lit(D)), X.day(lit(None).cast("long"), "unknown")) == ("1970-01-02", "unknown")
    assert one(spark, *(X.day_seconds(lit(t)) for t in ("1970-01-02", "January 2, 1970", "Jan 2 1970", "nonsense"))) == (D, D, D, None)
    assert one(spark, X.day_in_text(lit("on January 2, 1970 or 1970-01-03")), X.day_in_text(lit("never"))) == (2 * D, None)
    assert one(spark, X.iso_seconds(lit("1970-01-01T01:00:00+01:00")), X.iso_seconds(lit("1970-01-01T00:00:05Z")), X.iso_seconds(lit("x"))) == (0, 5, None)
    assert one(spark, X.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(0.0))), X.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == (1.0, 0.0)
    assert one(spark, X.path_category(lit("Work/x.md")), X.path_category(lit("associates/x")), X.path_category(lit("x.md")), X.path_category(lit("claude-session://work/x"))) == ("Procedural", "Semantic", "Episodic", "Episodic")
    assert one(spark, X.type_label(lit("Goal")), X.type_label(lit("Person")), X.type_name(lit('{"Custom": "Goal"}'))) == ("Custom(Goal)", "Person", "Goal")
    assert one(spark, X.tool_summary(lit("Read"), lit('{"file_path": "/a/b.py"}')), X.tool_summary(lit("Bash"), lit('{"command": "ls"}')), X.tool_summary(lit("Todo"), lit("{}"))) == ("Read: b.py", "Bash: ls", "Todo")
    assert one(spark, X.language_of(lit("a.PY")), X.language_of(lit("a.b")), X.session_project(lit("claude-session://p/1"))) == ("Python", "Unknown", "p")
    assert one(spark, X.set_hash(F.array(lit("a"), lit("b"))) == X.set_hash(F.array(lit("b"), lit("a")))) == (True,)
    assert (X.cli_seconds("1970-01-02"), X.cli_seconds(" ")) == (D, None)
    with pytest.raises(ValueError):
        X.cli_seconds("soon")


def test_python_syntax_check(spark):
    rows = spark.createDataFrame([("x = 1", "Python"), ("x = (", "Python"), ("x = (", "Go")], "s string, k string")
    assert [r["v"]["valid"] for r in rows.select(X.python_parses(F.col("s"), F.col("k")).alias("v")).collect()] == [True, False, True]


def test_model_answers(spark):
    lit = F.lit
    read = lambda t: [(e["name"], e["entity_type"]) for e in one(spark, X.entities_in(lit(t)))[0] or []]
    want = [("Ann", "person")]
    assert read('```json\n[{"name": "Ann", "type": "Person"}]\n```') == want
    assert read("Sure: [{'Entity': 'Ann', 'kind': 'person',}]") == want
    assert read('{"entities": [{"mention": "Ann", "label": "person"}]}') == want
    assert read('1. {"name": "Ann", "type": "person"}\n2. {"name": "Bo"}') == [*want, ("Bo", "concept")]
    assert read("nothing") == []
    labels = ("decision", "discussion", "background")
    assert one(spark, X.single_label(lit("**Decision** because"), labels), X.single_label(lit("?"), labels)) == ("decision", "background")
    assert one(spark, X.batch_labels(lit("1. decision\n2) discussion\n3. decision"), labels, lit(2)), X.batch_labels(lit("decision"), labels, lit(2))) == (["decision", "discussion"], None)
    assert one(spark, X.batch_tags(lit('{"1": [{"name":"a"}], "3": []}'), lit(3)))[0] == ['[{"name":"a"}]', None, "[]"]


def test_forms(spark):
    texts = {
        "meeting_transcript": ["**Alice:** Hello\n**Bob:** Hi", "**Alice**: Hello", "Speaker 1: Hello"],
        "date_structured": ["2024-09-15\na\n2024-09-16\nb", "# November 18, 2024\nx\n# November 19, 2024\ny"],
        "markdown": ["# Title\n\n## Section One\ntext"],
        "plain_text": ["one\n\ntwo", "", "2024-09-15\nonly one"],
    }
    for kind, some in texts.items():
        for t in some:
            assert one(spark, parsing.document_type(F.lit(t))) == (kind,), t


def parse(spark, text):
    rows = parsing.parsed(spark.createDataFrame([("d", text, "Episodic")], "source_document string, text string, memory_category string")).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [(r["section_name"], r["speaker"], r["timestamp"], r["text"]) for r in rows]


def test_parsed_documents(spark):
    assert parse(spark, "one\n\ntwo\n \nthree") == [(None, None, None, x) for x in ("one", "two", "three")]
    assert parse(spark, "  \n ") == []
    assert parse(spark, "intro\n\n## A\na1\n\na2\n### B\nb") == [(None, None, None, "intro"), ("A", None, None, "a1"), ("A", None, None, "a2"), ("B", None, None, "b")]
    assert parse(spark, "short\n1970-01-02\nfirst\n## x\n1970-01-03\nsecond\n") == [("1970-01-02", None, D, "first\n## x"), ("1970-01-03", None, 2 * D, "second")]
    turns = parse(spark, "## Kickoff\n" + "word " * 12 + "\n**Ann:** hello\n## Next\nmore\nSpeaker 2: bye")
    assert [(t[0], t[1]) for t in turns] == [("Kickoff", None), ("Next", "Ann"), ("Next", "Speaker 2")] and turns[1][3].startswith("hello")
    assert len(parse(spark, " ".join(f"Sentence number {i} is here." for i in range(400)))) > 1


def test_long_texts_overlap_by_sentences():
    text = " ".join(f"s{i} a b c d e f g h i." for i in range(100))
    parts = parsing.split_long(text, 130, 30)
    assert all(parsing._tokens(p) <= 130 for p in parts)
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(parts, parts[1:]))
    words = parsing.split_long(" ".join(map(str, range(250))), 130, 13)
    assert words[0].split()[-10:] == words[1].split()[:10] and words[-1].split()[-1] == "249"
    assert parsing.split_long("a b", 130, 30) == ["a b"]


def test_word_windows_match_the_plain_split(spark):
    for n in (0, 1, 99, 100, 101, 190, 191, 500):
        text = " ".join(map(str, range(n)))
        got = one(spark, parsing.word_windows(F.lit(text), 130, 13))[0]
        assert got == ([] if n == 0 else parsing.split_long(text, 130, 13) if n * 1.3 > 130 else [text])


def session(*lines):
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)


def line(kind, content, **more):
    return {"type": kind, "sessionId": "s1", "cwd": "/home/x/proj", "gitBranch": "main", "message": {"content": content}, **more}


def test_sessions(spark):
    tool = lambda n, p: {"type": "tool_use", "name": n, "input": {"file_path": p}}
    text = session(
        {"type": "file-history-snapshot"}, line("user", "Fix it", timestamp="1970-01-01T00:00:10Z"),
        line("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Looking"}, tool("Read", "/a/b.py"), tool("Read", "/a/c.py")]),
        "not json", "", line("user", [{"type": "tool_result", "content": "out"}], timestamp="1970-01-01T00:00:20Z"), line("assistant", [tool("Bash", "x")]),
        line("user", [{"type": "text", "text": "Thanks"}], timestamp="1970-01-01T00:00:30Z"), line("assistant", "Done"), line("user", "", timestamp="1970-01-01T00:00:40Z"), line("assistant", [tool("Bash", "y")]),
    )
    lines = conversations.session_lines(spark.createDataFrame([("f", text), ("empty", session({"type": "file-history-snapshot"}))], "session string, text string"))
    e = conversations.exchanges(lines).orderBy("number").collect()
    assert [(x["number"], x["user_text"], x["assistant_texts"], x["tool_uses"]) for x in e] == [(1, "Fix it", ["Looking"], ["Read: b.py", "Read: c.py"]), (2, "", [], ["Bash: x"]), (3, "Thanks", ["Done"], [])]
    m = conversations.session_metadata(lines).where("session = 'f'").first()
    assert (m["session_id"], m["project_name"], m["git_branch"], m["exchange_count"], m["tool_usage_summary"]) == ("s1", "proj", "main", 3, {"Read": 2, "Bash": 1})
    assert (m["start_time"], m["end_time"]) == ("1970-01-01T00:00:10Z", "1970-01-01T00:00:30Z")
    c = conversations.session_chunks(lines).orderBy("position").collect()
    assert c[0]["text"] == "User: Fix it\n\nAssistant: Looking\n\n[Tools: Read x2]"
    assert [(x["source_document"], x["section_name"], x["timestamp"]) for x in c] == [("claude-session://proj/s1", f"Exchange {i}", i * 10) for i in (1, 2, 3)]
    long = conversations.session_chunks(lines, most=3).where("section_name like 'Exchange 1 %'").orderBy("position").collect()
    assert [x["section_name"] for x in long][:2] == ["Exchange 1 (part 1)", "Exchange 1 (part 2)"]


def test_ingestion_links_replaces_and_skips(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "source_document string, text string, memory_category string")
    g = core(spark)
    first = ingestion.ingest(g, docs(("work/a.md", "We decided that Nils Berg joins Falcon.", "Procedural"), ("work/b.md", "hello everyone", "Procedural")), 1000)
    assert {r["source_document"]: (r["status"], r["chunks"]) for r in first.results.collect()} == {"work/a.md": ("complete", 1), "work/b.md": ("complete", 0)}
    names = {r["canonical_name"]: r["id"] for r in first.state.entities.collect()}
    assert {"Nils Berg", "Falcon"} <= set(names) and names["Nils Berg"] == "e-nils"
    chunk = first.state.chunks.where("source_document = 'work/a.md'").first()
    assert chunk["chunk_type"] == "Decision" and set(chunk["tags"]) >= {"e-nils", names["Falcon"]}
    assert first.state.mentions.where(f"entity_id = 'e-nils' and chunk_id = '{chunk['id']}'").count() == 1
    assert first.state.entity_documents.where("entity_id = 'e-nils' and document = 'work/a.md'").count() == 0
    again = ingestion.ingest(first.state, docs(("work/a.md", "We decided that Nils Berg joins Falcon.", "Procedural")), 2000)
    assert again.results.count() == 0
    added = ingestion.ingest(first.state, docs(("work/a.md", "Falcon is late.", "Procedural")), 2000).state
    swapped = ingestion.ingest(first.state, docs(("work/a.md", "Falcon is late.", "Procedural")), 2000, replace=True).state
    n = lambda s: s.chunks.where("source_document = 'work/a.md'").count()
    assert (n(added), n(swapped)) == (2, 1)
    assert ingestion.rolled_up(first.results).first()["complete"] == 2


def test_ingestion_into_an_empty_graph(spark):
    docs = spark.createDataFrame([("a", "Ann met Bo Li.", "Episodic")], "source_document string, text string, memory_category string")
    s = ingestion.ingest(GraphState.empty(spark), docs, 5).state
    assert {r["canonical_name"] for r in s.entities.collect()} == {"Ann", "Bo Li"} and s.edges.count() == 2


class Failing(ingestion.RuleClient):
    def tag(self, texts):
        return [None if "bad" in t else [] for t in texts]


def test_circuit_breaker_gives_a_document_up(spark):
    rows = spark.createDataFrame([(f"c{i}", "d", i, "bad") for i in range(20)] + [(f"k{i}", "e", i, "fine") for i in range(3)], "id string, source_document string, position int, text string")
    out = ingestion.tagged(rows, Failing()).groupBy("source_document").agg(F.count("*").alias("n"), F.count_if("failed").alias("f")).collect()
    assert {r["source_document"]: (r["n"], r["f"]) for r in out} == {"d": (5, 5), "e": (3, 0)}


def test_close_names_link_or_wait_for_review(spark):
    g = core(spark)
    rows = spark.createDataFrame([("c", "d", "the Atlas here", False, [("Atlas", "project")])], "id string, source_document string, text string, failed boolean, tags array<struct<name:string,entity_type:string>>")
    vectors = spark.createDataFrame([("e-atlas", [1.0, 0.0])], "entity_id string, vector array<double>")
    for v, existing, reviews in (([1.0, 0.1], "e-atlas", 0), ([1.0, 0.8], None, 1), ([0.0, 1.0], None, 0)):
        found = ingestion.linked(g, rows, vectors, spark.createDataFrame([("atlas", v)], "key string, vector array<double>"))
        assert found.tagged.first()["existing_id"] == existing and found.review.count() == reviews


class Strict(ingestion.RuleClient):
    """Rejects batches that hold "odd" as a whole, and fails on "bad"."""

    def classify(self, texts):
        if len(texts) > 1 and any("odd" in t for t in texts):
            raise OSError("rejected")
        return None if "bad" in texts[0] and len(texts) == 1 else ["decision" if "yes" in t else "discussion" for t in texts]

    def tag(self, texts):
        if len(texts) > 1 and any("odd" in t for t in texts):
            return None
        return [None if "bad" in t else [("X", "person")] for t in texts]


def test_rejected_batches_are_asked_text_by_text(spark):
    rows = [(f"c{i}", "d", i, t) for i, t in enumerate(["odd yes", "bad", "yes", "plain", "bad odd", "yes", "plain", "plain", "plain", "plain", "plain"])]
    frame = spark.createDataFrame(rows, "id string, source_document string, position int, text string").coalesce(1)
    got = {r["id"]: r["label"] for r in ingestion.classified(frame, Strict()).collect()}
    assert [got[f"c{i}"] for i in range(11)] == ["decision", "background", "decision", "discussion", "background", "decision", *["discussion"] * 5]
    tags = {r["id"]: r["failed"] for r in ingestion.tagged(frame, Strict()).collect()}
    assert [k for k, v in tags.items() if v] == ["c1", "c4"] and len(tags) == 11


def test_a_very_long_document_is_tagged_in_bounded_runs(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("long").alias("source_document"), F.col("id").cast("int").alias("position"), F.when(F.col("id") < 100_000, "fine").otherwise("bad").alias("text"))
    n = ingestion.tagged(rows, Failing(), retries=0).agg(F.count("*").alias("n"), F.count_if("failed").alias("f")).first()
    assert (n["n"], n["f"]) == (200_000, 100_000)  # never over half
    flipped = rows.withColumn("text", F.when(F.col("position") < 1000, "fine").otherwise("bad"))
    n = ingestion.tagged(flipped, Failing(), retries=0).agg(F.count("*").alias("n"), F.count_if("failed").alias("f")).first()
    assert (n["n"], n["f"]) == (2005, 1005)


def test_statuses(spark):
    docs = spark.createDataFrame([("a", "We decided that Ann leads.", "Episodic"), ("b", None, "Episodic"), ("c", "  ", "Episodic"), ("d", "bad news for Ann Lee", "Episodic")], "source_document string, text string, memory_category string")
    done = ingestion.ingest(core(spark), docs, 5, Failing())
    assert {r["source_document"]: (r["status"], r["chunks"], r["failed_chunks"]) for r in done.results.collect()} == {"a": ("complete", 1, 0), "b": ("failed", 0, 0), "c": ("complete", 0, 0), "d": ("partial", 1, 1)}
    assert {r["document"] for r in done.state.document_hashes.collect()} >= {"a", "c", "d"} and done.state.document_hashes.where("document = 'b'").count() == 0
    assert done.state.chunks.where("source_document = 'd'").count() == 0
    assert ingestion.rolled_up(done.results).first()["failed"] == 1


def test_prompts_by_source(spark, tmp_path):
    for name, text in {"classify": "one {chunk_text}", "classify_batch": "many {chunks}", "tag": "tag {chunk_text}", "tag_batch": "tags {chunks}", "tag_conversation": "talk {chunk_text}"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    asked = []

    def chat(prompt):
        asked.append(prompt)
        if prompt.startswith("many"):
            return "1. decision\n2) Preference\n"
        return {"one ": "Decision.", "tags": "Sure: {'1': [{'name': 'Ann', 'type': 'Person'},], '2': 7}", "tag ": '[{"name": "Bo"}, {"x": 1}]', "talk": "no"}[prompt[:4]]

    client = labelling.PromptClient(chat, files.prompts(spark, str(tmp_path)), ("decision", "preference"))
    assert client.classify(["a"]) == ["decision"] and client.classify(["a", "b"]) == ["decision", "preference"] and client.classify(["a", "b", "c"]) is None
    assert client.tag(["a"]) == [[("Bo", "concept")]] and client.tag(["a", "b"]) == [[("Ann", "person")], None]
    talk = client.for_source(True)
    assert talk.tag(["a"]) == [None] and asked[-1] == "talk a" and talk.classify(["a"]) == ["decision"] and talk.tag(["a", "b"])[1] is None and asked[-1] == "tags ---CHUNK 1---\na\n\n---CHUNK 2---\nb"


def test_ignore_rules_of_nested_folders(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n!keep.log\n/build/\ndocs/**/tmp\n# note\n\\#odd\nname with blank   \n*.py[co]\n!sub/\na/**/z.txt\n",
        "x.log": "", "keep.log": "", "build/a.py": "", "lib/build/a.py": "", "__init__.py": "x", "_hidden/.dot/c.txt": "c", "docs/tmp/a": "", "docs/a/b/tmp/q": "", "docs/a/b/tmpx": "", "#odd": "", "name with blank": "",
        "m.pyc": "", "m.py": "", "a/z.txt": "", "a/b/c/z.txt": "", "a/b/y.txt": "",
        "sub/.gitignore": "!*.log\nsecret*\n/only.txt\ndeep/\n", "sub/x.log": "", "sub/secret.txt": "", "sub/in/secret2": "", "sub/only.txt": "", "sub/in/only.txt": "", "sub/deep/a.txt": "", "sub/in/deep/.gitignore": "!a.txt\n", "sub/in/deep/a.txt": "",
        "neg/.gitignore": "*\n!*/\n!*.md\n", "neg/a.md": "", "neg/a.txt": "", "neg/in/b.md": "", "neg/in/c.txt": "", "node_modules/x.js": "", "lib/node_modules/y.js": "", "[lit]/f.txt": "", "sub/ü.txt": "ü",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    listed = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "-o", "--exclude-standard"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
    want = {x for x in listed if x and "node_modules" not in x.split("/")}
    assert len(want) >= 15
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert {r["path"] for r in files.repository(spark, root, ignored_dirs=("node_modules",)).collect()} == want
    assert {r["path"]: r["content"] for r in files.repository(spark, str(tmp_path), ["txt"]).collect()}["sub/ü.txt"] == "ü"
    assert files.repository(spark, str(tmp_path / "none")).count() == 0


def test_expected_entities(spark, tmp_path):
    (tmp_path / "a.md.expected.json").write_text(json.dumps({"entities": [{"name": " Ann ", "type": "person"}, {"name": "", "type": "x"}, {"name": "Bo", "type": "person", "aliases": ["B"]}]}))
    (tmp_path / "b.expected.json").write_text("{}")
    assert sorted(map(tuple, files.expected_entities(spark, str(tmp_path)).collect())) == [("a.md", "Ann", "person", []), ("a.md", "Bo", "person", ["B"])]


def test_evaluation(spark):
    pairs = lambda *x: spark.createDataFrame(x, "document string, name string")
    q = evaluation.extraction_quality(pairs(("d", "A"), ("d", "B")), pairs(("d", "a"), ("d", "c"))).first()
    assert (q["precision"], q["recall"], q["f1"]) == (0.5, 0.5, 0.5)
    assert evaluation.resilience(pairs(("d", ""), ("e", "")), pairs(("d", "A"))).first()["score"] == 0.5
    r = evaluation.compared(spark.createDataFrame([("m", 0.5, 0.4), ("n", 0.5, 0.505), ("o", 0.1, None)], "name string, score double, baseline_score double")).collect()
    assert [x["winner"] for x in r] == ["graph", "tie", None]
    assert evaluation.run({"bad": lambda: 1 / 0})[0]["error"]


def test_sources(spark, tmp_path):
    (tmp_path / "meetings").mkdir()
    (tmp_path / "meetings/a.md").write_text("x")
    (tmp_path / "b.md").write_text("  ")
    assert [(r["source_document"], r["memory_category"]) for r in files.markdown(spark, str(tmp_path)).collect()] == [("meetings/a.md", "Episodic")]
    repo = tmp_path / "repo"
    (repo / "node_modules").mkdir(parents=True)
    (repo / "build").mkdir()
    for name in ("a.py", "b.log", "node_modules/c.py", "build/d.py"):
        (repo / name).write_text("pass")
    (repo / ".gitignore").write_text("*.log\nbuild/\n")
    assert {r["path"] for r in files.repository(spark, str(repo)).collect()} == {".gitignore", "a.py"}
    over = tmp_path / "over"
    over.mkdir()
    (over / "1.json").write_text(json.dumps({"version": 1, "source_id": "s", "text": "t"}))
    (over / "2.json").write_text("{broken")
    assert sorted((r["valid"], r["category"]) for r in files.overflow(spark, str(over)).collect()) == [(False, "Episodic"), (True, "Episodic")]
    (tmp_path / "lore.json").write_text('["a", "b"]')
    assert [r["source_document"] for r in files.lore(spark, str(tmp_path / "lore.json")).collect()] == ["lore://entry/0", "lore://entry/1"]
    (tmp_path / "s.toml").write_text("[context]\nanchor_count_max = 7\nunknown = 1\n")
    assert files.settings(str(tmp_path / "s.toml")).anchor_count_max == 7
    (tmp_path / "w.toml").write_text("[tagging]\nreview_threshold = 0.9\n")
    with pytest.raises(ValueError):
        files.settings(str(tmp_path / "w.toml"))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "type": "retrieval", "question": "?", "expected_entities": ["A"]}]))
    assert files.evaluation_queries(spark, str(tmp_path / "q.json"), evaluation.QUERY_TYPES).count() == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.jsonl").write_text("{}")
    assert files.sessions(spark, str(tmp_path), "p/one").count() == 1 and files.sessions(spark, str(tmp_path), "other").count() == 0


def test_vector_baseline(spark):
    from mnemoweave.plans.embedding import hashing_embedder

    docs = spark.createDataFrame([("a", "red apples\n\nblue sky", "Episodic"), ("b", "green grass", "Episodic")], "source_document string, text string, memory_category string")
    found = evaluation.baseline_retrieve(evaluation.baseline_index(docs), hashing_embedder(["blue sky"])[0], 1).first()
    assert (found["source_document"], found["text"]) == ("a", "blue sky") and found["similarity"] == pytest.approx(1)
