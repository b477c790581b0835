"""Models against rows of the synthetic tables that they did not learn from."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoweave.llm import language_id, quality, toxicity

BIG, SMALL = Path("/root/testdata/sf0.1"), Path("/root/testdata/sf0.01")


def _ranked_right(scores, labels):
    """The share of pairs of a positive and a negative that the scores put in order; ties count half."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
def test_languages_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and trim(text) <> ''").select("doc_id", "lang")
    rows = language_id.query(spark, str(SMALL)).where("held_out and lang_pred <> 'und'").join(truth, "doc_id")
    n, right = rows.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 250 and right >= 0.97 * n


@pytest.mark.skipif(not BIG.exists(), reason="no test data")
@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.97)])
def test_scores_of_held_out_documents(spark, operator, label, least):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", label).where(F.col(label).isNotNull())
    rows = operator.query(spark, str(BIG)).where("held_out").join(labels, "doc_id").select("score", label).collect()
    scores, truth = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    assert len(rows) > 400 and _ranked_right(scores, truth) >= least
