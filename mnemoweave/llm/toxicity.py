"""Toxicity by non-negative positive-unlabelled learning.

A confirmed toxic text is a positive; every other text of the learning fold is unlabelled.  Words and word beginnings
get a log-likelihood ratio whose denominator is corrected by the class prior (unlabelled texts are a mixture of toxic
and clean ones), taken at a cautious bound of its sampling error; a word counts by the best of its own.  A text is
described by its largest ratios; a numpy linear model over that description is trained on the non-negative risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with
logistic loss.  In training each text's own counts are left out of its ratios.

The class prior is the share of toxic rows among all labelled rows of the learning fold.  Training uses at most
``POSITIVES`` labelled toxic rows and ``UNLABELLED`` rows of the fold, the first in a fixed pseudo-random order; these
are, with ``SAMPLE_CHARS`` characters in all, the documented bounds of the fit.  Every text is scored whole.

A null text is an empty one; texts without a known word get the score of an empty description.  Without a positive row
every score is 0.  Repeated rows give repeated results; of repeated labels the largest counts, null labels are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoweave.llm.common import fold_of, sample_order, table

POSITIVES = 4000
UNLABELLED = 6000
SAMPLE_CHARS = 64_000_000  # of both together; the text in which the bound is reached is still taken whole
TOP = 4
CAUTION = 1.5
EPOCHS = 800
BEGINNINGS = (3, 4, 5)
LEAST_SHARE = 400
_KNOWN_WORDS = 300_000
_LETTERS = bytes.maketrans(
    bytes(range(65, 91)) + bytes(i for i in range(128) if not chr(i).isalpha()),
    bytes(range(97, 123)) + b" " * sum(not chr(i).isalpha() for i in range(128)),
)


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def marks_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of ``BEGINNINGS`` bytes where they are shorter."""
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def _ratio(a: np.ndarray, n_p: float, u: np.ndarray, n_u: float, prior: float) -> np.ndarray:
    """Cautious log of P(word | toxic) over P(word | clean), from document counts a of n_p and u of n_u."""
    a, u = np.maximum(a, 0), np.maximum(u, 0)
    toxic = (a + 0.5) / (n_p + 1)
    clean = (u + 0.5 + CAUTION * np.sqrt(u + 0.5)) / (n_u + 1) - prior * toxic
    clean = np.maximum(clean, 0.5 / (n_u + 1)) / (1 - prior)
    return np.log(toxic / clean) - CAUTION / np.sqrt(a + 0.5)


def _describe(ratios: np.ndarray) -> np.ndarray:
    best = np.zeros(TOP)
    top = np.sort(ratios[ratios > 0])[::-1][:TOP]
    best[: len(top)] = top
    return np.append(best, [np.log1p(np.exp(np.minimum(ratios[ratios > 0], 20)).sum()), 1.0])


class Model:
    """Ratios of words and beginnings, and the weights of the description."""

    def __init__(self, ratios: dict[bytes, float], weights: np.ndarray | None, centre: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.ratios, self.weights, self.centre, self.scale = ratios, weights, centre, scale
        self.known: dict[bytes, float] = {}

    def best(self, word: bytes) -> float:
        r = max(self.ratios.get(x, 0.0) for x in marks_of(word))
        if len(self.known) >= _KNOWN_WORDS:
            self.known.clear()
        self.known[word] = r
        return r

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        get = self.known.get
        x = _describe(np.array([r for w in words_of(text) if (r := r if (r := get(w)) is not None else self.best(w))]))
        return float(1 / (1 + np.exp(-np.clip(((x - self.centre) / self.scale) @ self.weights, -30, 30))))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights minimising the non-negative PU risk with logistic loss, by Adam over whole batches."""
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, epochs + 1):
        zp, zu = positive @ w, unlabelled @ w
        g_plus = -prior * (positive * (1 - sigmoid(zp))[:, None]).mean(0)
        g_minus = (unlabelled * sigmoid(zu)[:, None]).mean(0) - prior * (positive * sigmoid(zp)[:, None]).mean(0)
        r_minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = (g_plus + g_minus if r_minus >= 0 else -g_minus) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], shared: list[bool], prior: float) -> Model:
    """``shared`` tells which of ``unlabelled`` are among ``positive`` too."""
    if not positive or not unlabelled:
        return Model({}, None)
    prior = float(np.clip(prior, 0.001, 0.9))
    a, u = Counter(), Counter()
    for count, texts in ((a, positive), (u, unlabelled)):
        for ws in texts:
            count.update({x for w in ws for x in marks_of(w)})
    n_p, n_u = len(positive), len(unlabelled)
    least = 1 if n_p < 50 else 2 + n_p // LEAST_SHARE
    vocabulary = [x for x, n in a.items() if n >= least]
    number = {x: i for i, x in enumerate(vocabulary)}
    ca, cu = np.array([a[x] for x in vocabulary], float), np.array([u[x] for x in vocabulary], float)

    def described(texts: list[set[bytes]], in_p: list[bool], in_u: bool) -> np.ndarray:
        rows = []
        for ws, p in zip(texts, in_p):
            pairs = [(k, number[x]) for k, w in enumerate(ws) for x in marks_of(w) if x in number]
            k, i = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            best = np.zeros(len(ws))
            np.maximum.at(best, k, _ratio(ca[i] - p, n_p - p, cu[i] - in_u, n_u - in_u, prior))
            rows.append(_describe(best))
        return np.array(rows)

    p, q = described(positive, [True] * n_p, False), described(unlabelled, shared, True)
    centre, scale = q.mean(0), q.std(0)
    centre[-1], scale = 0, np.where(scale > 1e-9, scale, 1)
    weights = nnpu((p - centre) / scale, (q - centre) / scale, prior)
    ratios = _ratio(ca, n_p, cu, n_u, prior)
    return Model({w: float(r) for w, r in zip(vocabulary, ratios) if r > 0}, weights, centre, scale)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> Model:
    """From texts and labels.toxic of rows outside the held-out fold."""
    fold = fold_of("doc_id", modulus) != 0
    marks = labels.where(fold & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return Model({}, None)
    texts = docs.where(fold & F.col("text").isNotNull()).select("doc_id", "text")
    confirmed = marks.where("toxic = 1").orderBy(*sample_order("doc_id")).limit(POSITIVES).select("doc_id")
    drawn = texts.select("doc_id").orderBy(*sample_order("doc_id")).limit(UNLABELLED)
    chosen = confirmed.withColumn("p", F.lit(True)).join(drawn.distinct().withColumn("u", F.lit(True)), "doc_id", "full")
    rows = texts.join(chosen, "doc_id")
    before = F.sum(F.length("text")).over(Window.orderBy(*sample_order("doc_id"), "text").rowsBetween(Window.unboundedPreceding, -1))  # of a bounded sample
    few = rows.select("doc_id", "text", "p", "u", F.coalesce(before, F.lit(0)).alias("before"))
    rows = few.where(F.col("before") < SAMPLE_CHARS).orderBy("doc_id", "text")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [b" ".join(sorted(words_of(x.as_py()))) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), b.column(1), b.column(2)], names=["words", "p", "u"])

    positive, unlabelled, shared = [], [], []
    for r in rows.select("text", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u")).mapInArrow(reduce, "words binary, p boolean, u boolean").toLocalIterator():
        ws = set(bytes(r["words"]).split())
        if r["p"]:
            positive.append(ws)
        if r["u"]:
            unlabelled.append(ws)
            shared.append(r["p"])
    return fit(positive, unlabelled, shared, toxic / n)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of POSITIVES texts at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(x.as_py()) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
