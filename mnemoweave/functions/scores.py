"""Numbers: similarities, weights, decay, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoweave.schemas import EDGE_WEIGHTS, SCORE_WEIGHTS

__all__ = ["cosine", "combined_score", "decayed", "distance_weight", "edge_weight", "jaccard", "score_weight", "stars", "token_estimate"]


def _lookup(c: Column, values: dict, default: float) -> Column:
    out = F.lit(float(default))
    for k, v in values.items():
        out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def edge_weight(chunk_type: Column) -> Column:
    """The weight a co-occurrence in a chunk of this type starts with."""
    return _lookup(chunk_type, EDGE_WEIGHTS, 1.0)


def score_weight(chunk_type: Column) -> Column:
    """What a chunk of this type counts for in retrieval."""
    return _lookup(chunk_type, SCORE_WEIGHTS, 0.5)


def distance_weight(hop: Column) -> Column:
    """1 for hops 0 and 1, then half for each further hop."""
    return 1 / F.pow(F.lit(2.0), F.greatest(hop - 1, F.lit(0)))


def combined_score(similarity: Column, rank: Column, top_rank: Column, for_similarity: float = 0.8, for_rank: float = 0.2) -> Column:
    return similarity * for_similarity + F.when(top_rank > 0, rank / top_rank).otherwise(0.0) * for_rank


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def decayed(count: Column, updated_at: Column, now: int, half_life_days: float) -> Column:
    """An access count after exponential decay since ``updated_at``, rounded half up."""
    age = F.greatest(F.lit(now) - updated_at, F.lit(0))
    return F.round(count * F.exp(age * (-0.6931471805599453 / (half_life_days * 86400)))).cast("long")


def stars(rank: Column, top: Column) -> Column:
    """One to five stars, by the share of the top rank."""
    n = F.when(top > 0, F.ceil(rank / top * 5)).otherwise(1)
    return F.repeat(F.lit("★"), F.least(F.greatest(n, F.lit(1)), F.lit(5)).cast("int"))


def token_estimate(text: Column) -> Column:
    """1.3 tokens for each word, cut to a whole number; words as Unicode white space parts them."""
    return (F.regexp_count(text, F.lit(r"(?U)\S+")) * 1.3).cast("int")
