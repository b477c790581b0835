"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each text is reduced to ``STATISTICS``: counts on a log scale, shares on a logit scale.  For each label the mean and the
covariance are summed over all labelled rows of the learning fold; covariances are shrunk towards their diagonal and
towards the pooled covariance, and factored once (Cholesky).  The score is the posterior of label 1 from the difference
of the two Mahalanobis log-densities and the log prior odds.

Only the sums travel to the driver: for each label a count, a vector and a matrix, whatever the number of rows.

A null text is an empty one.  Without rows of both labels every score is the share of label 1 (0 without any label).
Repeated rows give repeated results; of repeated labels the largest counts, null labels are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.llm.common import fold_of, materialise, table

THRESHOLD = 0.3
TO_DIAGONAL = 0.1
TO_POOLED = 0.1
#: Rows of a share of 2 % that each text is taken to have besides its own, so that short texts are not extreme.
SMOOTHING = 20
STATISTICS = (
    "log chars", "log words", "log lines", "mean word length", "spread of word length", "upper case", "digits", "marks", "odd marks", "spaces",
    "distinct words for length", "commonest word", "same word again", "repeated lines", "words with a mark inside", "short words",
    "exclamations", "sentence ends", "capitalised words", "longest word", "entropy",
)
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 letters and other bytes, 1 upper, 2 digit, 3 mark, 4 odd mark, 5 space, 6 bang, 7 stop
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 0 if _c.isalpha() else 5 if _c.isspace() or _b < 32 else 6 if _c in "!?" else 7 if _c in ".," else 4 if _c in "#$%&*+<=>@\\^_`{|}~" else 3


def _share(part: float, whole: float) -> float:
    p = (part + 0.02 * SMOOTHING) / (whole + SMOOTHING)
    return float(np.log((p + 0.002) / (max(1 - p, 0) + 0.002)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    octets = np.frombuffer(raw, np.uint8)
    per_byte = np.bincount(octets, minlength=256)
    kind = np.bincount(_CLASS, weights=per_byte, minlength=8)
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x]
    letters = kind[0] + kind[1]
    p = per_byte[per_byte > 0] / max(len(raw), 1)
    capital = sum(1 for w in counts if 65 <= w[0] <= 90 and w[1:] == w[1:].lower())
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        _share(kind[1], letters),
        _share(kind[2], len(raw)),
        _share(kind[3], len(raw)),
        _share(kind[4], len(raw)),
        _share(kind[5], len(raw)),
        float(np.log((len(counts) + 1) / (n + 1) ** 0.8)),
        _share(max(counts.values(), default=0), n),
        _share(sum(a == b for a, b in zip(words, words[1:])), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(c for w, c in counts.items() if not w[:-1].isalnum() and w.isascii()), n),
        _share(int((sizes <= 3).sum()), n),
        _share(kind[6], len(raw)),
        _share(kind[7], n),
        _share(capital, len(counts)),
        float(np.log1p(sizes.max())),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
    ]


class Discriminant:
    """Means, cached Cholesky factors and log priors of the two labels."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {k: s[0] for k, s in sums.items()}
        total = sum(n.values())
        self.share = n.get(1, 0) / total if total else 0.0
        self.parts = None
        if n.get(0, 0) < 2 or n.get(1, 0) < 2:
            return
        mean = {k: sums[k][1] / n[k] for k in (0, 1)}
        cov = {k: sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = sum(cov[k] * n[k] for k in (0, 1)) / total
        d = len(mean[0])
        self.parts = {}
        for k in (0, 1):
            few = d / (d + n[k])  # rely on the pooled covariance where rows are few
            c = (1 - TO_POOLED) * (1 - few) * cov[k] + (TO_POOLED + few - TO_POOLED * few) * pooled
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.parts[k] = (mean[k], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n[k] / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        z = {k: c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for k, (m, f, c) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(z[1] - z[0], -30, 30)))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>): the statistics of every text, written once to the shared folder.

    Fitting and scoring read these instead of the texts, which are read in one pass and never shuffled.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(reduce, "doc_id long, x array<double>"))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def learn(rows: DataFrame, labels: DataFrame, modulus: int = 5) -> Discriminant:
    """From described texts and labels.quality of all rows outside the held-out fold."""
    fold = fold_of("doc_id", modulus) != 0
    marks = labels.where(fold & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = rows.where(fold).join(marks, "doc_id").select("x", "label")
    d = len(STATISTICS)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.hstack([np.ones((b.num_rows, 1)), _rows(b.column(0))])
            y = b.column(1).to_numpy()
            for k in np.unique(y):
                sums[int(k)] = sums.get(int(k), 0) + x[y == k].T @ x[y == k]
        if sums:
            flat = [s.ravel() for s in sums.values()]
            size = (d + 1) ** 2
            cols = [pa.array(np.repeat(list(sums), size), pa.int32()), pa.array(np.tile(np.arange(size), len(sums)), pa.int32()), pa.array(np.concatenate(flat))]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "cell", "v"])

    total = known.mapInArrow(reduce, "label int, cell int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    grids: dict[int, np.ndarray] = {}
    for r in total.collect():  # two labels times (d + 1)^2 cells
        grids.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["cell"]] = r["v"]
    return Discriminant({k: (g.reshape(d + 1, d + 1)[0, 0], g.reshape(d + 1, d + 1)[0, 1:], g.reshape(d + 1, d + 1)[1:, 1:]) for k, g in grids.items()})


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for each described text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two means and factors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_rows(b.column(1))))], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(table(spark, sf_dir, "documents"))
    found = scored(rows, learn(rows, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
