"""Each operator against a plain version of itself, and on odd inputs."""

import hashlib
import random
import re
import zlib
from uuid import uuid4

import numpy as np
import pytest
import xxhash
from helpers import DOCS, docs, odd, partition, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemoweave.llm import bpe, common, decontaminate, language_id, line_dedup, quality, simhash_dedup, substring_dedup, topk, toxicity, url_filter


# shared parts
def test_components_have_the_smallest_member_as_root(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (1, 2), (2, 1)]
    got = {x["node"]: x["root"] for x in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = partition(pairs, {n for p in pairs for n in p})
    assert got == {n: w for n, w in want.items() if n in got} and all(w == n for n, w in want.items() if n not in got)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_majority_bits_over_many_hashes():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 2, 3, 254, 255, 256, 1000, 0, 5])
    h = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    got, at = common.majority_bits(h, sizes), 0
    for g, n in zip(got, sizes):
        part = [int(x) for x in h[at : at + n]]
        at += n
        assert int(g) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in part) > n)


def test_runs_cut_across_batches():
    import pyarrow as pa

    keys = [1] * 3 + [2] * 10 + [3] + [4] * 25 + [5] * 2
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(list(range(i, min(i + size, len(keys)))))], names=["k", "v"]) for i in range(0, len(keys), size)]
        seen, cut = [], {}
        for whole, (k, v) in common.runs(iter(batches), 1, 5):
            seen += v.tolist()
            for key in set(k.tolist()):
                cut.setdefault(key, []).append(whole)
        assert sorted(seen) == list(range(len(keys)))
        assert cut[1] == cut[3] == cut[5] == [True]
        assert not any(cut[4][:-1]) or size == 1


# 1 URL filters
def test_url_lists_hold_at_fetch_time(spark):
    lists = spark.createDataFrame(
        [("spam", "bad.org", "add", "2024-01-10"), ("spam", "bad.org", "remove", "2024-02-10"), ("spam", "bad.org", "add", "2024-03-10"), ("allowed", "ok.bad.org", "add", "2024-01-01"), ("paths", "mixed.com/x", "add", "2024-01-01"), (None, "bad.org", "add", "2024-01-01"), ("spam", "bad.org", "add", None), ("spam", "same.day", "remove", "2024-01-01"), ("spam", "same.day", "add", "2024-01-01"), ("spam", "Upper.ORG.", "add", "2024-01-01"), ("paths", "Cased.net/Abc", "add", "2024-01-01")],
        "list_name string, entry string, action string, listed_on string",
    )
    cases = [
        ("http://bad.org/a", "2024-01-09", "keep"), ("http://bad.org/a", "2024-01-10", "drop"), ("https://u@www.Bad.org:80/a?b", "2024-02-09", "drop"), ("http://bad.org", "2024-02-10", "keep"),
        ("http://bad.org.", "2024-04-01", "drop"), ("http://ok.bad.org/", "2024-01-20", "keep"), ("http://notbad.org/", "2024-01-20", "keep"), ("http://mixed.com/x/y", "2024-01-20", "drop"), ("http://mixed.com/xy", "2024-01-20", "keep"),
        (None, "2024-01-20", "keep"), ("nonsense", "2024-01-20", "keep"), ("", "2024-01-20", "keep"), ("http://bad.org/a", None, "keep"), ("http://same.day/", "2024-01-01", "drop"),
        ("http://www.upper.org/", "2024-01-20", "drop"), ("http://cased.net/Abc/d", "2024-01-20", "drop"), ("http://cased.net/abc/d", "2024-01-20", "keep"), ("http://upper.org/" + "x" * 100_000, "2024-01-20", "drop"),
    ]
    rows = [(i, u, d) for i, (u, d, _) in enumerate(cases)]
    got = url_filter.judge(spark.createDataFrame([*rows, rows[1]], "page_id long, url string, fetched_on string"), lists).collect()
    assert len(got) == len(cases) + 1
    assert {r["page_id"]: r["verdict"] for r in got} == {i: c[2] for i, c in enumerate(cases)}
    assert url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, fetched_on string"), lists.limit(0)).where("verdict = 'drop'").count() == 0


def test_url_filter_runs_no_python(spark, data):
    plan = url_filter.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2 line dedup
def test_edit_distance_limit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    r = random.Random(5)
    for _ in range(800):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 14))) for _ in range(2))
        d = distance(a, b)
        assert line_dedup.within(a, b, d) and not line_dedup.within(a, b, d - 1)


def plain_lines(rows):
    occurs = {}
    for i, text in rows:
        for n, x in enumerate(text.split("\n") if i is not None and text is not None else []):
            if w := line_dedup.normal_words(x):
                occurs.setdefault(b" ".join(w), []).append((i, n))
    forms = list(occurs)
    keys = [set() for _ in forms]
    for i, k in zip(*map(np.ndarray.tolist, line_dedup.block_keys([f.split() for f in forms]))):
        keys[i].add(k)
    links = [(i, j) for i in range(len(forms)) for j in range(i) if keys[i] & keys[j] and line_dedup.similar(forms[i].decode("utf-8", "replace"), forms[j].decode("utf-8", "replace"))]
    groups = {}
    for i, root in partition(links, range(len(forms))).items():
        groups.setdefault(root, []).extend(occurs[forms[i]])
    return {o for g in groups.values() for o in sorted(g)[1:]}


def line_rows():
    r = random.Random(2)
    base = [" ".join(words(k, 40)) for k in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(words(r.random(), 3))
            lines.append(" ".join(w) + r.choice(["", ".", "!!"]))
        rows.append((i, "\n".join(lines)))
    hot = " ".join(words("hot", 80)).split()
    for i in range(60, 100):  # many variants of one line
        v = list(hot)
        v[i % 80] += "x"
        rows.append((i, " ".join(v) + "\n\nThe end 12.\nthe END 34"))
    return rows


@pytest.mark.parametrize("most", [1024, 8])
def test_repeated_lines_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "KEY_ROWS", most)
    rows = line_rows()
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows) and len(got) > 100


def altered(line, kind, r):
    w, c = line.split(), list(line)
    if kind == "word":
        w[r.randrange(len(w))] = "replaced"
        return " ".join(w)
    for i in r.sample(range(len(c)), {"letter": 1, "letters": max(1, len(c) // 25)}[kind]):
        c[i] = r.choice("klmnopqrst")
    return "".join(c)


@pytest.mark.parametrize("most", [1024, 8])
def test_similar_lines_meet(spark, monkeypatch, most):
    """Recall against brute force on edit similarity alone, and no link that brute force has not."""
    monkeypatch.setattr(line_dedup, "KEY_ROWS", most)
    r, found = random.Random(11), []
    for k in range(120):
        line = " ".join(words(f"s{k}", (6, 10, 20, 60)[k % 4]))
        found += [line, altered(line, ("word", "letter", "letters")[k % 3], r)]
    rows = [(i, x) for i, x in enumerate(found)]
    forms = [b" ".join(line_dedup.normal_words(x)).decode() for x in found]
    links = [(i, j) for i in range(len(forms)) for j in range(i) if line_dedup.similar(forms[i], forms[j])]
    want = {i for i, root in partition(links, range(len(forms))).items() if i != root}
    got = {x["doc_id"] for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)


def test_real_lines_with_a_change_share_a_block(data):
    """Of lines of the tables, one word or one letter of which is replaced, and still similar; by their number of words."""
    import pyarrow.parquet as pq

    r, lines = random.Random(5), {}
    for text in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist():
        lines |= {b" ".join(w): None for x in (text or "").split("\n") if len(w := line_dedup.normal_words(x)) >= 4}
    lines = r.sample(sorted(lines), min(1500, len(lines)))
    for kind, least in (("word", 0.95), ("letter", 0.97), ("letters", 0.8)):
        pairs = [(x.decode(), " ".join(altered(x.decode(), kind, r).split())) for x in lines]
        pairs = [p for p in pairs if line_dedup.similar(*p)]
        keys = [[set() for _ in pairs] for _ in range(2)]
        for side in range(2):
            for i, k in zip(*map(np.ndarray.tolist, line_dedup.block_keys([p[side].encode().split() for p in pairs]))):
                keys[side][i].add(k)
        assert len(pairs) > 500 and sum(bool(a & b) for a, b in zip(*keys)) >= least * len(pairs), kind


def test_line_dedup_keeps_columns_and_odd_rows(spark):
    d = odd(spark)
    out = line_dedup.without_repeated_lines(d.unionByName(d.where("doc_id = 6").withColumn("doc_id", F.lit(8).cast("long"))))
    assert out.columns == d.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[6] == "no letters 123 !?" and got[8] == "" and got[None].startswith("some words")
    assert {r["n_chars"] for r in out.where("doc_id = 8").collect()} == {0} and out.count() == d.count() + 1
    assert line_dedup.without_repeated_lines(d.limit(0)).count() == 0


def test_blocks_past_the_first_sixteen_bring_lines_together(spark):
    """A line of 64 classes, in the first 16 of which a word each is replaced."""
    line = {}
    for w in words("long", 600, "abcdefghijklmnopqrst"):
        if len(line) < 160 and len(w) > 4:
            line[w] = line_dedup._WordHashes()[w.encode()] >> 58
    first = {c: w for w, c in line.items() if c < 16}
    assert len(line) == 160 and len(first) > 10
    texts = [" ".join(line), " ".join("replaced" + str(c).translate(str.maketrans("0123456789", "abcdefghij")) if first.get(c) == w else w for w, c in line.items())]
    assert line_dedup.similar(*texts)
    assert [r["doc_id"] for r in line_dedup.repeated_lines(docs(spark, texts)).collect()] == [1]


def test_pairs_compared_together_are_judged_like_single_ones():
    r, texts = random.Random(8), []
    for k in range(150):
        line = "".join(r.choice("abcdefg é€") for _ in range(r.choice([3, 40, 64, 65, 128, 129, 200, 500, 700])))
        texts.append(line)
        for share in (0.1, 0.19, 0.21):
            c = list(line)
            for _ in range(int(len(c) * share)):
                i = r.randrange(len(c))
                c[i] = r.choice(("", "xx", "y"))
            texts.append("".join(c) or "z")
    a = np.array([i for i in range(len(texts)) for _ in range(9)])
    b = np.array([i // 4 * 4 + j if j < 4 else r.randrange(len(texts)) for i in range(len(texts)) for j in range(9)])
    want = np.array([line_dedup.similar(texts[i], texts[j]) for i, j in zip(a, b)])
    linked = line_dedup._Linked(texts)
    assert (linked.similar(a, b) == want).all() and 500 < want.sum() < len(want) - 500 and linked.may(a, b)[want].all()


def test_long_lines_are_compared_many_at_a_time(monkeypatch):
    """Pairs of 3 to 1500 letters near the limit are judged together, as the edit distance of each says."""
    r, texts = random.Random(4), []
    for size in (3, 60, 64, 65, 310, 330, 640, 700, 900, 1500):
        for _ in range(30):
            line = [r.choice("abcdefg é") for _ in range(size)]
            texts.append("".join(line))
            for _ in range(int(size * r.choice((0.1, 0.22, 0.26, 0.3)))):
                line[r.randrange(size)] = r.choice(("", "xx", "y"))
            texts.append("".join(line) or "z")
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    want = np.array([line_dedup.within(texts[i], texts[j], line_dedup.limit_of(texts[i], texts[j])) for i, j in zip(a, b)])
    monkeypatch.setattr(line_dedup, "within", lambda *x: pytest.fail("a single pair was compared"))
    got = line_dedup._Linked(texts).similar(a, b)
    assert (got == want).all() and 80 < want.sum() < len(want) - 80


def test_unlike_letters_and_plain_copies_need_no_edit_distance(monkeypatch):
    """Lines of other letters are told apart by the letters' counts, long lines of a few words more or less by going along both."""
    mixed, vowels = " ".join(words("m", 60)), " ".join(words("v", 60, "aeiou"))
    monkeypatch.setattr(line_dedup, "PIECES", 1)  # no piece tells lines apart
    linked = line_dedup._Linked([mixed, vowels])
    assert not linked.may(np.array([0]), np.array([1])).any()
    long = words("l", 300)
    texts = [" ".join(long), " ".join(long[:40] + ["one", "more"] + long[40:200] + long[203:])]
    refuse = lambda *a: pytest.fail("the edit distance was taken")
    monkeypatch.setattr(line_dedup, "within", refuse)
    assert line_dedup._Linked(texts).similar(np.array([0]), np.array([1])).all()


def test_what_going_along_two_lines_costs_is_no_less_than_their_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = [r.choice("ab c") for _ in range(r.randrange(1, 90))]
        b = list(a)
        for _ in range(r.randrange(0, 12)):
            b[r.randrange(len(b))] = r.choice(["", "x", "ab", "  c"])
        a, b, limit = "".join(a), "".join(b), r.randrange(0, 20)
        assert not line_dedup._aligned_within(a, b, limit) or line_dedup.within(a, b, limit)


def test_keys_of_lines_are_shuffled_in_parts(spark, monkeypatch, tmp_path):
    """No sorted run of keys holds all of them, and the parts together drop what brute force drops."""
    rows, folder, whole = line_rows(), str(tmp_path), line_dedup.sharing

    def counted(batches):
        batches = list(batches)
        for b in batches:
            np.save(f"{folder}/{uuid4().hex}", b.column(0).to_numpy() % line_dedup.SLICES)
        yield from whole(iter(batches))

    monkeypatch.setattr(line_dedup, "sharing", counted)
    got = {(x["doc_id"], x["line"]) for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = [set(np.load(f).tolist()) for f in tmp_path.iterdir()]
    assert got == plain_lines(rows) and seen and all(len(x) == 1 for x in seen) and len(set().union(*seen)) == line_dedup.SLICES


def test_texts_of_lines_are_packed(spark, monkeypatch):
    """What is stored and shuffled of a line's text is packed."""
    types, whole = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df: types.append(dict(df.dtypes)) or whole(df))
    rows = line_rows()
    got = {(x["doc_id"], x["line"]) for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows) and [t["form"] for t in types if "form" in t] == ["binary"]


def test_links_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    seen, components = [], line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "KEY_ROWS", 32)
    monkeypatch.setattr(line_dedup, "connected_components", lambda links: seen.append(links.count()) or components(links))
    hot = words("hot", 30)
    texts = [" ".join(w + "x" * (i % 30 == n) + "y" * (i // 30 == n) for n, w in enumerate(hot)) for i in range(600)]
    got = line_dedup.repeated_lines(docs(spark, texts)).select("doc_id").collect()
    assert len(got) == 599 and seen[0] < 20 * len(texts), seen


def test_majority_of_few_hashes():
    r = np.random.default_rng(4)
    sizes = r.integers(0, 40, 3000)
    h = r.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) & r.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    ends = np.cumsum(sizes)
    want = [np.packbits(bits[e - n : e].sum(axis=0) * 2 > n).view(np.uint64)[0] for n, e in zip(sizes.tolist(), ends.tolist())]
    assert (common.majority_bits(h, sizes) == np.array(want, np.uint64)).all()


def test_classes_of_too_few_features_are_not_summed(monkeypatch):
    seen, whole = [], line_dedup.majority_bits
    monkeypatch.setattr(line_dedup, "majority_bits", lambda h, n: seen.extend(n.tolist()) or whole(h, n))
    line, keys = line_dedup.block_keys([[w.encode() for w in words(k, 200)] for k in range(20)])
    assert len(keys) and len(seen) == len(keys) and min(seen) >= line_dedup.LEAST_MEMBERS


def test_lines_too_far_in_length_make_no_pair(monkeypatch):
    """Unlike lines of one key, each a tenth longer than the one before: after the stars only near lengths are paired."""
    import pyarrow as pa
    import zstandard

    r, n, texts = random.Random(6), 200, []
    while len(texts) < 12:
        texts.append("".join(r.choice("abcdefghij ") for _ in range(int(n * 1.1 ** len(texts)))))
    r.shuffle(texts)
    joined, whole = [], line_dedup._Linked.join
    monkeypatch.setattr(line_dedup._Linked, "join", lambda self, a, b, told: joined.append({(len(self.texts[x]), len(self.texts[y])) for x, y in zip(a, b)}) or whole(self, a, b, told))
    cols = {"_g": [1] * 12, "h1": list(range(12)), "h2": [0] * 12, "form": [zstandard.compress(t.encode()) for t in texts], "keys": [[7]] * 12, "piece": [0] * 12, "cross": [False] * 12}
    assert not list(line_dedup._alike(iter([pa.RecordBatch.from_pydict(cols)])))
    near = {(a, b) for a in map(len, texts) for b in map(len, texts) if a < b and b - a <= int(0.2 * b + 1e-9)}
    assert joined[-1] == near and len(joined) == 2 * line_dedup.STARS + 1


def test_pieces_far_from_their_place_tell_lines_apart():
    """The bound on places never rules out a pair within its limit, and rules out most unlike ones of the same letters."""
    r = random.Random(9)
    texts = ["".join(r.choice("aaabbcdefghij  é") for _ in range(r.randint(3, 700))) for _ in range(160)]
    for t in list(texts):
        c = list(t)
        for _ in range(int(len(c) * r.choice((0.05, 0.15, 0.2)))):
            c[r.randrange(len(c))] = r.choice(("", "xy", "q"))
        texts.append("".join(c[r.choice((0, 3)) :]) or "z")
    linked = line_dedup._Linked(texts)
    a, b = map(np.array, zip(*[(i, j) for i in range(len(texts)) for j in range(i) if abs(len(texts[i]) - len(texts[j])) <= line_dedup.limit_of(texts[i], texts[j])]))
    limit = np.maximum(linked.limit[a], linked.limit[b])
    apart = line_dedup._pieces_apart(linked.pieces, linked.start, linked.size, a, b, limit)
    near = np.array([line_dedup.within(texts[i], texts[j], int(n)) for i, j, n in zip(a.tolist(), b.tolist(), limit.tolist())])
    assert near.sum() > 80 and not (apart & near).any() and apart.sum() > 0.8 * (~near).sum()


def test_texts_of_lines_are_shuffled_once(spark, monkeypatch):
    """The parts of the groups are joined with texts in buckets: each join shuffles its own side alone."""
    plans, whole, made = [], line_dedup.stored, line_dedup.in_buckets
    monkeypatch.setattr(line_dedup, "stored", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or whole(df))
    tables = []
    monkeypatch.setattr(line_dedup, "in_buckets", lambda df, key: tables.append(made(df, key)) or tables[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = line_rows()
        got = {(x["doc_id"], x["line"]) for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [p for columns, p in plans if columns == ["a1", "a2", "b1", "b2"]]
    assert got == plain_lines(rows) and len(joins) == line_dedup.SLICES
    assert all(p.count("Exchange hashpartitioning(h1") == 1 for p in joins), joins[0]
    assert not spark.catalog.tableExists(tables[0]._table)


# 3 language ID
def test_languages_of_held_out_texts(spark, data):
    found = language_id.query(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.collect()) and found.count() == truth.count()


def test_language_of_odd_rows(spark):
    train = {"en": b" ".join(w.encode() for w in words(1, 500)), "xx": b" ".join(w.encode() for w in words(2, 500, "klmnopqrst"))}
    got = {r["doc_id"]: r for r in language_id.classify(odd(spark), train, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 6)] == ["und", "und", "und", "en"] or got[6]["lang_pred"] in train
    assert got[1]["score"] == 0 and len(got) == 8
    assert language_id.classify(odd(spark).limit(0), train, "doc_id").count() == 0
    assert {r["lang_pred"] for r in language_id.classify(odd(spark), {}, "doc_id").collect()} == {"und"}
    assert language_id.learn(odd(spark), F.lit(True)) == {}
    kept = language_id.keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 0


@pytest.mark.parametrize("length", [12, 9000])
def test_languages_with_texts_of_one_length_only_are_learned(spark, length):
    rows = [(i, " ".join(words(f"{i}", length, "abcdefghij" if i % 2 else "klmnopqrst")), "en" if i % 2 else "xx", "s", None) for i in range(12)]
    d = spark.createDataFrame(rows, DOCS)
    found = language_id.learn(d, F.lit(True))
    assert sorted(found) == ["en", "xx"]
    assert all(r["lang_pred"] == r["lang"] for r in language_id.classify(d, found, "lang").collect())


def clashing(spark):
    """Documents whose extra columns have the names that operators return or use inside."""
    d = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate([" ".join(words(i, 60)) for i in range(6)])], DOCS)
    names = ["margin", "lang_pred", "score", "hit_words", "n_words", "item_ids", "_mw_gone", "gone", "h1", "key", "component_id", "leads", "c0", "c1", "row", "fp", "word", "block", "_t", "_h"]
    return d.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


def test_extra_columns_may_have_any_name(spark, data):
    import corpus_pipeline

    d = clashing(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, data)
        assert out.dtypes == d.dtypes
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(20))}
    assert bpe.encode_decode(d, from_files=False).count() == 6


# 4 decontamination
def plain_hits(text, items):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = lower(text), set(), set()
    for item, t in items:
        v = lower(t)
        m = min(10, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                ids.add(item)
    return len(w), sorted(hit), sorted(ids)


@pytest.mark.parametrize("slice_words", [2_000_000, 20])
def test_decontamination_matches_a_plain_search(spark, monkeypatch, slice_words):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", slice_words)
    r = random.Random(3)
    few = words(9, 12)
    items = [(f"i{k}", " ".join(r.choice(few) for _ in range(r.choice([1, 2, 5, 9, 10, 11, 30])))) for k in range(12)]
    items += [("i0", items[1][1]), ("none", None), ("blank", "?!"), ("Ö", "Éclair ça 9")]
    texts = [" ".join(r.choice(few) for _ in range(r.randint(0, 80))) for _ in range(40)] + [f"x, {items[3][1].upper()}! y", None, "", "ÉCLAIR ça-9 éclair ça 9 Éclair ça 9"]
    bench = spark.createDataFrame([*items, (None, "x y")], "item_id string, text string")
    got = {x["doc_id"]: x for x in decontaminate.mark(docs(spark, texts), bench, "doc_id").collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], list(got[i]["hit_words"]), list(got[i]["item_ids"])) == plain_hits(t, [x for x in items if x[1] is not None]), t


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([("a", "word " * 12)], "item_id string, text string")
    d = odd(spark)
    kept = decontaminate.keep_uncontaminated(d, bench)
    assert kept.columns == d.columns and kept.count() == d.count() - 1
    assert decontaminate.keep_uncontaminated(d, bench.limit(0)).count() == d.count()
    assert decontaminate.keep_uncontaminated(d.limit(0), bench).count() == 0


# 5 substring dedup
def test_chunks_join_up_and_resist_insertions():
    text = " ".join(words(4, 3000)).encode() + "é世界".encode() * 50
    parts = substring_dedup.chunks_of(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    for s, e in parts:
        text[s:e].decode()
    moved = b"inserted words " + text[:5000] + b" more " + text[5000:]
    own = {text[s:e] for s, e in parts}
    assert sum(e - s for s, e in substring_dedup.chunks_of(moved) if moved[s:e] in own) > 0.98 * len(text)


def test_shared_passages_are_found_and_clean_texts_left(spark):
    passage = [" ".join(words(f"p{k}", 60)) for k in range(20)]
    texts = [" ".join(words(i, 100)) for i in range(40)]
    for k, p in enumerate(passage):
        for i in (k, k + 20):
            texts[i] = texts[i][: 100 + i] + " " + p + " " + texts[i][100 + i :]
    texts += [" ".join(words(1000 + i, 200)) for i in range(20)] + [None, ""] + ["exact copy " + " ".join(words("c", 30))] * 3
    spans = substring_dedup.repeats(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in spans} == set(range(40)) | {62, 63, 64}
    for r in spans:
        raw = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert len(raw) >= substring_dedup.LEAST_BYTES and raw == texts[r["other_doc_id"]].encode()[r["other_start_byte"] :][: len(raw)]
        assert r["removable_bytes"] == (len(raw) if r["first_doc_id"] != r["doc_id"] else 0)
    assert {r["first_doc_id"] for r in spans if r["doc_id"] == 64} == {62}


def plain_repeats(texts):
    """(doc_id, start, end, other doc_id, other start) of what ``substring_dedup`` reports, piece by piece."""
    places = {}
    for i, raw in texts.items():
        for s, e in substring_dedup.pieces_of(raw):
            places.setdefault(raw[s:e], []).append((i, s))
    away, want = {}, set()
    for piece, at in places.items():
        at.sort()
        for n, (i, s) in enumerate(at):
            others = {at[0] if n else at[-1]} | ({at[n - 1]} if n and at[n - 1][0] == i else set())
            for j, o in others - {(i, s)}:
                away.setdefault((i, j, o - s), []).append((s, s + len(piece)))
    for (i, j, d), parts in away.items():
        spans = []
        for s, e in sorted(parts):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        want |= {(i, s, e, j, s + d) for s, e in spans if e - s >= substring_dedup.LEAST_BYTES}
    later = lambda r: (r[3], r[4]) < (r[0], r[1])
    inside = lambda r, q: r[1] >= q[1] and r[2] <= q[2] and (r[1:3] != q[1:3] or r[3:] > q[3:])
    by_doc = {}
    for r in want:
        by_doc.setdefault((r[0], later(r)), []).append(r)
    return {r for rows in by_doc.values() for r in rows if not any(inside(r, q) for q in rows if q is not r)}


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_match_a_plain_search(spark, data, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", hot)
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r["doc_id"], r["start_byte"], r["end_byte"], r["other_doc_id"], r["other_start_byte"]) for r in substring_dedup.query(spark, data).collect()}
    assert got == plain_repeats(texts) and got
    for i, s, e, j, o in got:  # whole at the other place
        assert texts[i][s:e] == texts[j][o : o + e - s]


def test_passages_that_repeat_in_one_document_are_found(spark):
    passage, between = " ".join(words("again", 80)), [" ".join(words(f"b{k}", 60)) for k in range(4)]
    text = " ".join([between[0], passage, between[1], passage, between[2], passage, between[3]])
    rows = substring_dedup.repeats(docs(spark, [text])).collect()
    assert len(rows) == 3 and sum(r["removable_bytes"] > 300 for r in rows) == 2
    for r in rows:
        size = r["end_byte"] - r["start_byte"]
        assert text.encode()[r["start_byte"] : r["end_byte"]] == text.encode()[r["other_start_byte"] :][:size] and text[r["start_byte"] : r["end_byte"]] in passage


def test_passages_from_different_documents_are_not_glued(spark):
    a, b = (" ".join(words(k, 60)) for k in ("glue a", "glue b"))
    texts = [a + " " + " ".join(words("one", 50)), " ".join(words("two", 50)) + " " + b, a + " " + b]
    spans = [r for r in substring_dedup.repeats(docs(spark, texts)).collect() if r["doc_id"] == 2]
    assert {r["other_doc_id"] for r in spans} == {0, 1}
    assert all(texts[2].encode()[r["start_byte"] : r["end_byte"]] in texts[r["other_doc_id"]].encode() for r in spans)


def test_a_repeated_row_keeps_its_spans_whole(spark):
    passage = " ".join(words("shared", 80))
    texts = [" ".join(words(i, 60)) + " " + passage + " " + " ".join(words(i + 50, 60)) for i in range(3)]
    d = docs(spark, texts)
    spans = lambda x: sorted(tuple(r) for r in substring_dedup.repeats(x).collect())
    want = spans(d)
    assert {r[0] for r in want} == {0, 1, 2} and max(r[2] - r[1] for r in want) > 300
    assert spans(d.unionByName(d.where("doc_id = 1")).unionByName(d.where("doc_id <> 0"))) == want
    other = docs(spark, [" ".join(words("other", 300))], 1)  # doc 1 once more with another text
    assert spans(d.unionByName(other)) == want


def test_repeats_of_odd_rows(spark):
    assert {r["doc_id"] for r in substring_dedup.repeats(odd(spark)).collect()} <= {4} and substring_dedup.repeats(odd(spark).limit(0)).count() == 0


# 6 and 10 classifiers
def labelled(spark, seed=0, n=400):
    r = random.Random(seed)
    common_words, bad = words("v", 300), ["vile", "nasty", "awful"]
    texts, marks = [], []
    for i in range(n):
        w = [r.choice(common_words) for _ in range(60)]
        toxic = int(r.random() < 0.2)
        if toxic:
            w[10:10] = r.sample(bad, 2)
        low = int(r.random() < 0.2)
        texts.append(" ".join(w).upper() + "!!!" * 20 if low else " ".join(w) + ".")
        marks.append((i, 1 - low, toxic))
    return docs(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, modulus, threshold):
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % modulus == 0]
    assert len(held) > 40 and all(0 <= r["score"] <= 1 for r in rows)
    return sum((r["score"] >= threshold) == bool(r[column]) for r in held) / len(held)


def test_toxicity_of_held_out_texts(spark):
    d, labels = labelled(spark)
    assert accuracy(toxicity.scored(d, toxicity.learn(d, labels)), labels, "toxic", 5, 0.5) > 0.95


def test_quality_of_held_out_texts(spark):
    d, labels = labelled(spark)
    rows = quality.described(d)
    assert accuracy(quality.scored(rows, quality.learn(rows, labels)), labels, "quality", 5, quality.THRESHOLD) > 0.95


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    d, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda f: [r["score"] for r in f.orderBy("doc_id").collect()]
    assert scores(toxicity.scored(d, toxicity.learn(d, labels))) == scores(toxicity.scored(d, toxicity.learn(d, turned)))
    rows = quality.described(d)
    assert scores(quality.scored(rows, quality.learn(rows, labels))) == pytest.approx(scores(quality.scored(rows, quality.learn(rows, turned))))


def test_classifiers_on_odd_rows(spark):
    d, labels = labelled(spark)
    repeated = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, None, None), (None, 1, 1)], labels.schema))
    model, none = toxicity.learn(d, repeated), toxicity.learn(d, labels.limit(0))
    assert toxicity.scored(odd(spark), model).count() == odd(spark).count()
    assert {r["score"] for r in toxicity.scored(odd(spark), none).collect()} == {0.0}
    rows = quality.described(odd(spark))
    assert quality.scored(rows, quality.learn(quality.described(d), repeated)).count() == odd(spark).count()
    assert {r["score"] for r in quality.scored(rows, quality.learn(rows, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in quality.scored(rows, quality.learn(quality.described(d), labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.scored(quality.described(d.limit(0)), quality.learn(rows, labels)).count() == 0


def test_nnpu_risk_stays_at_the_prior():
    rng = np.random.default_rng(0)
    one = lambda n, m: np.hstack([rng.normal(m, 1, (n, 1)), np.ones((n, 1))])
    p, u = one(300, 2), np.vstack([one(200, 2), one(800, -2)])
    w = toxicity.nnpu(p, u, 0.2)
    assert 0.15 < (u @ w > 0).mean() < 0.25


# 7 exact top-k
@pytest.mark.parametrize("shard", [8192, 50])
def test_topk_matches_all_products(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)] + [(400 + i, [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    vectors += [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, [0.5]), (None, [1.0]), (905, [])]
    got = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    ok = {r["vec_id"]: np.array(r["v"] + [0] * (6 - len(r["v"]))) for r in got.collect()}
    assert set(ok) == set(range(300)) | set(range(400, 440)) | {904, 905}
    found = {}
    for r in topk.search(got.where("vec_id % 20 = 0"), got, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ok if i % 20 == 0}
    for q, rows in found.items():
        want = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:20]
        assert sorted(rows) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_blocks_below_the_bound_are_skipped():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (8, 16))
    rows = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(0, 2, (2048, 16))).astype(np.int64)
    shard = topk.Shard(np.arange(2048), rows, int(np.abs(rows).max()))
    scores, _, used = shard.search(np.arange(0, 2048, 100), rows[::100], 20)
    assert used.mean() < 0.6 * len(shard.blocks)
    assert all(sorted((rows @ rows[q])[np.arange(2048) != q])[-20:] == sorted(s) for q, s in zip(range(0, 2048, 100), scores.tolist()))


def test_topk_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(topk.quantised(none), topk.quantised(none)).count() == 0


# 8 BPE
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def expected(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)), ids


def test_bpe_matches_the_library(spark, monkeypatch):
    t = tokenizer()
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    r = random.Random(8)
    parts = [*"aábZ '\"!.,0９²Ⅷ\n\t\r\x0b  　é世界😀_-\x00\x1c̀", "'s", "'re", "'ll", "'LL", "<|endoftext|>", "  ", "\n\n", " '", "'d", " word", "Word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "<|endoftext|>", "x" * 5000]
    rows = {x["doc_id"]: x for x in bpe.encode_decode(docs(spark, texts), ids=True, from_files=False).collect()}
    for i, text in enumerate(texts):
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"], rows[i]["token_ids"]) == expected(t, text), text


def test_bpe_of_tables(spark, data):
    t = tokenizer()
    got = {r["doc_id"]: r for r in bpe.query(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == expected(t, r["text"])[:2]


def test_bpe_of_odd_rows(spark):
    tokenizer()
    assert bpe.encode_decode(odd(spark), from_files=False).count() == odd(spark).count()
    assert bpe.encode_decode(odd(spark).limit(0), from_files=False).count() == 0


def test_words_are_split_over_arrays_of_bytes():
    """Kinds of characters and of their neighbours are held as bytes: 15 bytes a character in all, 27 as wider numbers."""
    import tracemalloc

    bpe.split_words(["first"])  # the table of kinds
    tracemalloc.start()
    bpe.split_words(["w" * 300_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * 300_000


def test_both_passes_of_a_block_number_its_words_alike():
    r, special = random.Random(4), ("<|endoftext|>",)
    texts = ["".join(r.choice((" ", "a1", " it's", "\n\t", "\u00e9", "<|endoftext|>", "word ")) for _ in range(r.randrange(40))) for _ in range(300)]
    whole, only = bpe._Block(special), bpe._Block(special, words_only=True)
    for at in range(0, 300, 100):
        whole.add(list(range(at, at + 100)), texts[at : at + 100])
        only.add(list(range(at, at + 100)), texts[at : at + 100])
    found, spelled = list(whole.words), []
    for _, sizes, numbers in whole.parts:
        ends, numbers = np.cumsum(bpe._unpacked(sizes)), bpe._unpacked(numbers).tolist()
        spelled += ["".join(found[i] for i in numbers[end - n : end]) for n, end in zip(bpe._unpacked(sizes).tolist(), ends.tolist())]
    assert list(only.words) == found and only.check() == whole.check() and spelled == texts


# 9 SimHash near-dedup
def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [1024, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "ANCHOR_ROWS", most)
    r = random.Random(4)
    texts = [" ".join(words(i, 200)) for i in range(40)]
    for _ in range(60):
        w = r.choice(texts[:5]).split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \x0b ", "One", "two words", texts[3].upper(), texts[7], texts[7]]
    got = simhash_dedup.near_duplicates(docs(spark, texts, 100)).collect()
    fp = {100 + i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = partition(links, fp)
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_every_close_pair_meets_at_an_anchor(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    rows = []
    for x in base.tolist():
        y = x
        for k in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            y ^= 1 << int(k)
        rows.append((np.uint64(x).view(np.int64).item(), np.array([y], dtype=np.uint64).view(np.int64)[0].item()))
    df = spark.createDataFrame(rows, "x long, y long")
    a = df.select(F.transform(F.filter(simhash_dedup.anchors(F.col("x")), lambda s: s["home"]), lambda s: s["anchor"]).alias("home"), F.transform(simhash_dedup.anchors(F.col("y")), lambda s: s["anchor"]).alias("all"))
    assert all(len(r["home"]) == 2 and len(r["all"]) <= 34 and set(r["home"]) & set(r["all"]) for r in a.collect())


def test_near_duplicates_of_odd_rows(spark):
    d = odd(spark)
    got = simhash_dedup.near_duplicates(d)
    assert got.count() == d.count()
    assert {r["component_id"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {1}
    kept = simhash_dedup.keep_one_of_each(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash_dedup.keep_one_of_each(d.limit(0)).count() == 0


def test_different_texts_of_one_id_both_stay(spark):
    one, other = " ".join(words("a", 50)), " ".join(words("b", 50))
    d = spark.createDataFrame([(1, one, "en", "s", 1), (1, other, "en", "s", 2), (1, one, "en", "s", 3), (2, one.upper(), "en", "s", 4)], DOCS)
    assert sorted((r["doc_id"], r["n_chars"]) for r in simhash_dedup.keep_one_of_each(d).collect()) == [(1, 1), (1, 2)]


def test_near_copies_are_verified_and_complete(spark):
    """The stage against brute force on the Jaccard similarity of five-word shingles."""
    r, texts = random.Random(21), []
    for k in range(30):
        base = words(f"n{k}", 300)
        texts.append(" ".join(base))
        for n in (1, 3, 5, 6, 9):  # a word takes five shingles with it
            w = list(base)
            for i in r.sample(range(300), n):
                w[i] = "changed"
            texts.append(" ".join(w))
    texts += ["one two", "One two", "one three"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = partition(links, range(len(sets)))
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.near_copies(docs(spark, texts)).collect()}
    assert got == want and len(set(want.values())) < 100
    assert {x["doc_id"] for x in simhash_dedup.keep_one_of_each(docs(spark, texts)).collect()} == set(want.values())


def test_the_stage_brings_texts_together_by_their_simhashes(spark, monkeypatch):
    """Without band keys, near copies whose SimHashes differ in at most 3 bits are linked; like SimHashes of unlike sets are not."""
    real = simhash_dedup._sketches

    def stage(change):
        def sketches(batches):
            import pyarrow as pa

            for b in real(batches):
                cols = dict(zip(b.schema.names, b.columns)) | {"keys": pa.array([[]] * b.num_rows, pa.list_(pa.int64()))} | change(b)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        monkeypatch.setattr(simhash_dedup, "_sketches", sketches)
        return {x["doc_id"]: x["component_id"] for x in simhash_dedup.near_copies(docs(spark, texts)).collect()}

    texts = [" ".join(words(f"c{k}", 400)) for k in range(20)]
    texts += [t + " end" for t in texts]
    found = [simhash_dedup.majority_bits(s, np.array([len(s)]))[0] for s in (simhash_dedup.shingle_set(simhash_dedup._words(t)) for t in texts)]
    near = [k for k in range(20) if np.bitwise_count(found[k] ^ found[k + 20]) <= 3]
    got = stage(lambda b: {})
    assert len(near) > 15 and all(got[k + 20] == (k if k in near else k + 20) for k in range(20))
    got = stage(lambda b: {"fp": b.column(0)})  # the first eight ids differ in at most three bits
    assert got == {k: k for k in range(40)} | {k: k - 20 for k in range(20, 40) if (k ^ (k - 20)).bit_count() <= 3}


# all
def test_all_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_decontaminate", "op7_exact_topk"])
def test_query_matches_sql(name, spark, data, duck):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    plain = lambda v: v if isinstance(v, (int, bool, type(None))) else str(v)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline

    source = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    kept = corpus_pipeline.run(spark, data)
    assert 0 < kept.count() <= source.count() and {"doc_id", "n_tokens", "token_ids"} <= set(kept.columns)
    assert kept.select("doc_id").distinct().count() == kept.count()


def test_pipeline_stages_keep_the_columns(spark, data):
    import corpus_pipeline

    d = odd(spark).select(*[c.split()[0] for c in DOCS.split(", ")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, data).dtypes == d.dtypes
