"""The spool, file events and the file graph."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemoweave import schemas
from mnemoweave.plans import ranking, repo
from mnemoweave.sources import changes
from mnemoweave.streaming import spool, watch
from mnemoweave.streaming.queue import Queue
from mnemoweave.streaming.watcher import Watcher

AT = datetime(2024, 1, 1)


def fragments(spark, *rows):
    """(id, source, text, status, extracted_at)"""
    return spark.createDataFrame([(i, s, t, "Episodic", None, None, i, at, st, None, None) for i, s, t, st, at in rows], schemas.FRAGMENTS)


def test_spool_states(spark):
    f = fragments(spark, (1, "b", "x", "pending", None), (2, "a", "y", "pending", None), (3, "a", "z", "pending", None), (4, "c", "w", "failed", None), (5, "c", "v", "extracting", 10), (6, "c", "u", "extracted", 20))
    assert {r["status"]: r["n"] for r in spool.histogram(f).collect()} == {"pending": 3, "extracting": 1, "extracted": 1, "failed": 1, "total": 6}
    claimed = spool.claim(f, 2)
    assert [r["id"] for r in claimed.collect()] == [2, 3]
    assert [(r["source_id"], r["text"], r["ids"]) for r in spool.by_source(claimed).collect()] == [("a", "y\n\nz", [2, 3])]
    done = spool.moved(f, claimed.select("id"), "extracted", 99, "b1")
    assert {(r["id"], r["extracted_at"], r["batch_id"]) for r in done.where("batch_id is not null").collect()} == {(2, 99, "b1"), (3, 99, "b1")}
    assert spool.recent_batches(done).first()["sources"] == ["a"]
    assert spool.reset_stale(f, 10 + 3601).where("extraction_status = 'pending'").count() == 4
    assert spool.retry_failed(f).where("extraction_status = 'failed'").count() == 0
    assert spool.retained(f, 20 + 31 * 86400).count() == 5
    ran = []
    assert spool.threshold_batches(f, 3, lambda rows: ran.append(rows.count())) and ran == [3]
    assert not spool.threshold_batches(f, 4, lambda rows: ran.append(0))


def test_capture_reads_each_fragment_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps({"id": i, "source_id": "s", "text": t}) for i, t in ((1, "a"), (2, " "))))
    spool.capture(spark, str(inbox), out, mark).awaitTermination()
    (inbox / "2.json").write_text(json.dumps({"id": 3, "source_id": "s", "text": "c"}))
    spool.capture(spark, str(inbox), out, mark).awaitTermination()
    assert sorted((r["id"], r["extraction_status"]) for r in spark.read.parquet(out).collect()) == [(1, "pending"), (3, "pending")]


def test_stored_overflow_is_known(spark):
    rows = spark.createDataFrame([("s", "text"), ("s", "other")], "source_id string, text string")
    hashes = rows.where("text = 'text'").select(F.col("source_id").alias("document"), F.sha2("text", 256).alias("sha256"))
    assert {r["text"]: r["known"] for r in spool.already_stored(rows, hashes).collect()} == {"text": True, "other": False}


def events(spark, *rows):
    return spark.createDataFrame([(p, k, AT + timedelta(milliseconds=ms)) for p, k, ms in rows], schemas.FILE_EVENTS)


def test_event_meaning(spark):
    e = events(spark, ("n.py", "create", 0), ("n.py", "create", 1), ("n.py", "remove", 2), ("n.py", "remove", 3), ("k.py", "create", 0), ("k.py", "rename", 1), ("k.py", "other", 2))
    got = watch.normalised_batch(e, spark.createDataFrame([("k.py",)], "path string")).orderBy("path", "at").collect()
    assert [(r["path"], r["event"]) for r in got] == [("k.py", "Modified"), ("k.py", "Modified"), ("n.py", "Created"), ("n.py", "Modified"), ("n.py", "Deleted")]
    assert watch.meaning("modify", True, exists=False) == ("Deleted", False)


def test_event_stream_keeps_what_is_known(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put = lambda n, *rows: (inbox / n).write_text("\n".join(json.dumps({"path": p, "kind": k, "at": f"2024-01-01T00:00:0{s}Z"}) for p, k, s in rows))
    seen = []

    def run():
        rows = spark.readStream.schema(schemas.FILE_EVENTS).json(str(inbox))
        q = watch.normalised(rows).writeStream.option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda df, _: seen.extend((r["path"], r["event"]) for r in df.collect())).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    put("1.json", ("a", "create", 1))
    run()
    put("2.json", ("a", "create", 2), ("a", "remove", 3))
    run()
    assert seen == [("a", "Created"), ("a", "Modified"), ("a", "Deleted")]


def test_filter_and_debounce(spark):
    e = events(spark, ("src/a.py", "create", 0), ("src/a.py", "modify", 50), ("src/a.py", "remove", 500), (".git/x.py", "create", 0), ("a.txt", "create", 0), ("src/skip.py", "create", 0))
    kept = watch.filtered(e, ["py"], [".git"], ["skip.py"])
    assert {r["path"] for r in kept.collect()} == {"src/a.py"}
    assert [(r["kind"]) for r in watch.debounced(kept).orderBy("at").collect()] == ["modify", "remove"]


def test_snapshot_changes(spark):
    listing = lambda *x: spark.createDataFrame(x, "path string, content_hash long")
    got = watch.snapshot_changes(listing(("a", 1), ("b", 1), ("c", 1)), listing(("b", 2), ("c", 1), ("d", 1)))
    assert {r["path"]: r["event"] for r in got.collect()} == {"a": "Deleted", "b": "Modified", "d": "Created"}


def test_repository_neighbourhood_and_updates(spark):
    edges = lambda *x: spark.createDataFrame(x, schemas.FILE_EDGES)
    start = spark.createDataFrame([("a",)], "path string")
    chain = edges(*(x + ("SymbolUsage",) for x in (("a", "b"), ("b", "c"), ("c", "d"))))
    assert {r["path"]: r["weight"] for r in repo.neighbourhood(chain, start, 3).collect()} == {"b": 1.0, "c": 0.5, "d": 0.25}
    imports = edges(("a", "b", "Import"), ("b", "c", "Import"), ("b", "d", "SymbolUsage"))
    assert {r["path"] for r in repo.neighbourhood(imports, start, 3).collect()} == {"b", "d"}
    r = repo.built(spark.createDataFrame([("a.py", "x"), ("b.bin", "y"), ("c.rs", "z")], "path string, content string"))
    r = r._replace(edges=edges(("a.py", "c.rs", "Import")))
    assert repo.statistics(r).first().asDict() == {"files": 2, "imports": 1, "usages": 0, "symbols": 0, "files_with_usages": 0, "unresolved": 0}
    gone = repo.without_files(r, spark.createDataFrame([("c.rs",)], "path string"))
    assert [(x["target"], x["waiters"]) for x in repo.unresolved(gone, 5).collect()] == [("c.rs", 1)] and gone.edges.count() == 0
    back = repo.with_file(gone, spark.createDataFrame([("c.rs", "new")], "path string, content string"))
    assert [(x["src"], x["dst"], x["kind"]) for x in back.edges.collect()] == [("a.py", "c.rs", "Import")] and back.waiting.count() == 0
    assert repo.inconsistencies(back).count() == 0
    ranks = ranking.pagerank(back.files.select(F.col("path").alias("id")), ranking.file_edges_weighted(back.edges))
    text = repo.map_text(repo.ranked_map(back.files, back.edges, ranks, 5))
    assert text.index("c.rs") < text.index("a.py") and "(1 dependents)" in text
    assert repo.adaptive(1000, 1000)["listed"] == 75


def test_context_files_come_in_tiers(spark):
    paths = [f"f{i}" for i in range(40)]
    r = repo.built(spark.createDataFrame([(f"{p}.py", "x") for p in paths], "path string, content string"))
    r = r._replace(edges=spark.createDataFrame([("f0.py", "f1.py", "SymbolUsage"), ("f1.py", "f2.py", "SymbolUsage"), ("f2.py", "f3.py", "SymbolUsage"), ("f5.py", "f6.py", "Import")], schemas.FILE_EDGES))
    ranks = r.files.select(F.col("path").alias("id"), F.when(F.col("path") == "f5.py", 1.0).otherwise(0.1).alias("rank"))
    similar = spark.createDataFrame([("f0.py", 0.9), ("f4.py", 0.6), ("f5.py", 0.55), ("f7.py", 0.1)], "path string, similarity double")
    asked = spark.createDataFrame([("f9.py",)], "path string")
    got = {x["path"]: x["tier"] for x in repo.context_files(r, ranks, similar, 2, 2, asked, hops=1).collect()}
    assert {p for p, t in got.items() if t == 0} == {"f9.py"} and {p for p, t in got.items() if t == 1} == {"f0.py", "f5.py"}  # rank lifts f5 over f4
    assert {p for p, t in got.items() if t == 2} == {"f1.py", "f6.py"} and {p for p, t in got.items() if t == 3} == {"f2.py"}
    assert {p for p, t in got.items() if t == 4} == {"f4.py", "f7.py"} and len(got) == 40


def test_repository_context_skips_what_does_not_fit(spark):
    r = repo.built(spark.createDataFrame([("a.py", "a" * 400), ("b.py", "b" * 4000), ("c.py", "c" * 40), ("test_x.py", "t"), ("d.py", " ")], "path string, content string"))
    r = r._replace(edges=spark.createDataFrame([("a.py", "b.py", "SymbolUsage"), ("a.py", "c.py", "SymbolUsage"), ("a.py", "test_x.py", "Import")], schemas.FILE_EDGES))
    ranks = ranking.pagerank(r.files.select(F.col("path").alias("id")), ranking.file_edges_weighted(r.edges))
    text = repo.context(r, ranks, spark.createDataFrame([("a.py", 0.9)], "path string, similarity double"), 400)
    assert text.index("## a.py") < text.index("## c.py") and "## b.py" not in text and "## test_x.py" not in text


def _told(w):
    w.catch_up()
    return sorted((r["path"], r["event"]) for r in w.drain().collect())


def test_watcher_tells_changes_once_across_restarts(spark, tmp_path):
    root, home = tmp_path / "tree", str(tmp_path / "home")
    (root / "in/.git").mkdir(parents=True)
    (root / "skip").mkdir()
    for name in ("a.py", "in/b.py", "in/note.txt", "in/.git/c.py", "skip/d.py"):
        (root / name).write_text("1")
    start = lambda: Watcher(spark, str(root), home, extensions=("py",), ignored_dirs=("skip",))
    w = start()
    try:
        assert _told(w) == []  # what is there is known
        (root / "a.py").write_text("22")
        (root / "n.py").write_text("1")
        (root / "in/note.txt").write_text("22")
        assert _told(w) == [("a.py", "Modified"), ("n.py", "Created")]
        (root / "in/b.py").rename(root / "in/r.py")
        assert _told(w) == [("in/b.py", "Deleted"), ("in/r.py", "Created")]
        assert not w.wait(0.5)
    finally:
        w.stop()
    (root / "n.py").unlink()
    (root / "in/r.py").write_text("333")
    (root / "in/late.py").write_text("1")
    w = start()
    try:
        assert w.wait(30) and _told(w) == [("in/late.py", "Created"), ("in/r.py", "Modified"), ("n.py", "Deleted")]
        assert _told(w) == []
        stats = w.stats()
        assert (stats["Created"], stats["Modified"], stats["Deleted"], stats["errors"], stats["running"]) == (3, 2, 2, 0, 1)
    finally:
        w.stop()
    assert w.stats()["running"] == 0


def test_existing_files_may_be_told(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_text("1")
    w = Watcher(spark, str(tmp_path / "tree"), str(tmp_path / "home"), existing="created")
    try:
        assert _told(w) == [("a.py", "Created")]
    finally:
        w.stop()


def test_listings_go_on_after_a_look_that_was_not_noted(tmp_path):
    """A version stored before a crash, but in no checkpoint, is a step on the way to the next one."""
    (tmp_path / "tree").mkdir()
    held = changes.Listings(str(tmp_path / "tree"), str(tmp_path / "state"))
    assert held.look() == held.look() == 0
    (tmp_path / "tree/a").write_text("1")
    assert held.look() == 1
    (tmp_path / "tree/b").write_text("1")
    (tmp_path / "tree/a").unlink()
    assert held.look() == 2
    reader = changes.FolderChanges({"path": str(tmp_path / "tree"), "state": str(tmp_path / "state")}).streamReader(None)
    told = lambda a, b: sorted(x[:2] for p in reader.partitions({"version": a}, {"version": b}) for x in reader.read(p))
    assert told(0, 2) == [("b", "Created")] and told(1, 2) == [("a", "Deleted"), ("b", "Created")] and told(2, 2) == [] and told(-1, 1) == [("a", "Created")]
    reader.commit({"version": 2})
    assert held.versions() == [2]


def _queued(spark, home, *rows):
    q = Queue(spark, str(home), lease=100)
    q.insert(spark.createDataFrame(rows, "source_id string, text string"), 10)
    return q


def _states(q, now):
    return {r["id"]: r["extraction_status"] for r in q.fragments(now).collect()}


def test_a_crash_between_claim_and_commit_neither_loses_nor_repeats(spark, tmp_path):
    q = _queued(spark, tmp_path, ("a", "one"), ("b", "two"), (" ", "no source"), ("a", "three"), ("c", ""))
    assert q.insert(spark.createDataFrame([("d", "four")], "source_id string, text string"), 11) == 1
    assert _states(q, 20) == dict.fromkeys((1, 2, 3, 4), "pending")
    batch = q.claim(20, 3)
    seen = []
    note = lambda df: seen.extend((r["source_id"], r["text"]) for r in df.collect())
    after = Queue(spark, str(tmp_path), lease=100)  # the first one crashed here
    assert sorted(_states(after, 50).values()) == ["extracting"] * 3 + ["pending"]
    assert after.work(note, 60) == {"d": None} and seen == [("d", "four")]
    assert after.work(note, 70) == {}
    assert _states(after, 119) == {1: "extracting", 2: "extracting", 3: "extracting", 4: "extracted"}
    assert _states(after, 121) == {1: "pending", 2: "pending", 3: "pending", 4: "extracted"}
    (tmp_path / "outcomes" / batch).mkdir()  # what a crash within the commit leaves: no mark of success
    assert _states(after, 121)[1] == "pending"
    assert after.run(batch, note, 130) == {"a": None, "b": None} and sorted(seen[1:]) == [("a", "one\n\nthree"), ("b", "two")]
    assert after.run(batch, note, 140) == {} and len(seen) == 3 and after.work(note, 150) == {}
    assert set(_states(after, 1000).values()) == {"extracted"}


def test_a_source_that_raises_leaves_the_others_extracted(spark, tmp_path):
    q = _queued(spark, tmp_path, *[(f"s{i}", "bad" if i in (2, 5) else "fine") for i in range(8)])
    done = []

    def extract(df):
        rows = df.collect()
        if any(r["text"] == "bad" for r in rows):
            raise ValueError("no answer")
        done.extend(r["source_id"] for r in rows)

    errors = q.work(extract, 20)
    assert {s for s, e in errors.items() if e} == {"s2", "s5"} and errors["s2"] == "ValueError: no answer"
    assert sorted(done) == ["s0", "s1", "s3", "s4", "s6", "s7"]
    rows = {r["source_id"]: (r["extraction_status"], r["error"]) for r in q.fragments(30).collect()}
    assert rows["s2"] == ("failed", "ValueError: no answer") and rows["s0"] == ("extracted", None)
    assert q.work(extract, 40) == {} and q.retry_failed(50) == 2
    assert {r["source_id"] for r in q.fragments(60).where("extraction_status = 'pending'").collect()} == {"s2", "s5"}
    assert q.work(lambda df: None, 70) == {"s2": None, "s5": None} and set(_states(q, 80).values()) == {"extracted"}
