"""Retrieval and extraction quality."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.operators.aggregates import precision_recall_f1
from mnemoweave.operators.lookups import keyword_hits
from mnemoweave.plans.embedding import Embedder, embedded, hashing_embedder, top_similar
from mnemoweave.plans.parsing import parsed

WIN_MARGIN = 0.01
QUERY_TYPES = ("retrieval", "temporal", "multi_hop", "filler_rejection", "cross_document_chain")


def extraction_counts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(document, tp, fp, fn) by lower-cased names of (document, name) rows."""
    side = lambda df, c: df.select("document", F.lower("name").alias("name")).distinct().withColumn(c, F.lit(1))
    both = side(expected, "e").join(side(found, "f"), ["document", "name"], "full_outer")
    e, f = F.col("e").isNotNull(), F.col("f").isNotNull()
    return both.groupBy("document").agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))


def extraction_quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(precision, recall, f1), micro-averaged."""
    total = extraction_counts(expected, found).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return total.select(*precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def keyword_score(answers: DataFrame) -> DataFrame:
    """(score): mean share of keywords found over (query_id, context, keywords) rows, to four places."""
    share = F.when(F.size("keywords") > 0, keyword_hits(F.col("context"), F.col("keywords")) / F.size("keywords")).otherwise(0.0)
    return answers.agg(F.round(F.avg(share), 4).alias("score"))


def context_efficiency(answers: DataFrame, queries: int = 30) -> DataFrame:
    """(score): mean keyword hits for a thousand tokens over the first queries."""
    words = F.size(F.filter(F.split("context", r"(?U)\s+"), lambda w: w != ""))
    tokens = words * 1.3
    per = F.when(words > 0, keyword_hits(F.col("context"), F.col("keywords")) / tokens * 1000).otherwise(0.0)
    return answers.orderBy("query_id").limit(queries).agg(F.round(F.avg(per), 4).alias("score"))


def resilience(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(score): the share of documents with an entity."""
    has = found.select("document").distinct().withColumn("has", F.lit(1))
    return documents.select("document").distinct().join(has, "document", "left").agg(F.avg(F.coalesce("has", F.lit(0))).alias("score"))


def compared(results: DataFrame) -> DataFrame:
    """Rows (name, score, baseline_score) with the winner beyond a small margin."""
    s, b = F.col("score"), F.col("baseline_score")
    return results.withColumn("winner", F.when(b.isNull(), None).when(s > b + WIN_MARGIN, "graph").when(s < b - WIN_MARGIN, "baseline").otherwise("tie"))


def run(metrics: dict[str, Callable[[], DataFrame]]) -> list[dict]:
    """Each metric's score, or the error it failed with."""
    out = []
    for name, metric in metrics.items():
        try:
            out.append({"name": name, **metric().first().asDict(), "error": None})
        except Exception as e:  # noqa: BLE001  a metric's failure is part of the report
            out.append({"name": name, "error": str(e)[:500]})
    return out


def report_text(results: list[dict], counts: dict[str, int], warnings: int = 10) -> str:
    """A report to read: counts, a line for each metric with its winner, how often the graph won, the first warnings."""
    shown = lambda v: "--" if v is None else f"{v:.4f}"
    width = max([len(r["name"]) for r in results], default=6)
    lines = [", ".join(f"{v} {k}" for k, v in counts.items()), f"{'metric':<{width}}  {'graph':>8}  {'baseline':>8}  winner"]
    winners = []
    for r in results:
        s, b = r.get("score"), r.get("baseline_score")
        winner = "--" if s is None or b is None else "graph" if s > b + WIN_MARGIN else "baseline" if s < b - WIN_MARGIN else "tie"
        winners += [winner] if winner != "--" else []
        lines.append(f"{r['name']:<{width}}  {shown(s):>8}  {shown(b):>8}  {winner}")
    if winners:
        lines.append(f"graph ahead in {winners.count('graph')} of {len(winners)} compared metrics")
    errors = [f"{r['name']}: {r['error']}" for r in results if r.get("error")]
    lines += [f"- {e}" for e in errors[:warnings]] + ([f"- and {len(errors) - warnings} more"] if len(errors) > warnings else [])
    return "\n".join(lines)


def report_json(results: list[dict], counts: dict[str, int], at: int) -> str:
    """The same as JSON, with the time."""
    return json.dumps({"at": at, "counts": counts, "metrics": results}, indent=2, sort_keys=True)


def baseline_index(docs: DataFrame, embed: Embedder = hashing_embedder) -> DataFrame:
    """(id, source_document, text, vector): the chunks of documents with vectors, and no graph."""
    chunks = parsed(docs).withColumn("id", F.concat_ws("#", "source_document", "position"))
    return embedded(chunks.select("id", "source_document", "text"), "text", embed)


def baseline_retrieve(index: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(id, similarity, source_document, text): the k nearest chunks."""
    best = top_similar(index.select("id", "vector"), "id", query, k)
    return best.join(index.select("id", "source_document", "text"), "id").orderBy(F.desc("similarity"), "id")
