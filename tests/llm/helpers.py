"""Small inputs for the operators of a training-data pipeline."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n, alphabet="abcdefghij"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n)]


def odd(spark):
    """Nulls, empty and long texts, a repeated row, extra columns with names the operators use inside."""
    rows = [(1, None), (2, ""), (3, "   \n\n"), (None, "some words without an id here"), (4, "word " * 60_000), (5, "twice the same row"), (5, "twice the same row"), (6, "no letters 123 !?"), (7, "😀 emoji and \x00 control")]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS + ", line string, fp int, kept int")


def partition(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
