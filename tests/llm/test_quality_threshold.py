import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktide.llm import quality_rules as q


def by_definition(score, quality):
    """The middle of the widest gap with the least sum of error rates, each cut tried."""
    good, bad, at = score[quality == 1], score[quality == 0], np.unique(score)
    cuts = np.concatenate([[at[0]], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    errors = np.array([(good < c).mean() + (bad >= c).mean() for c in cuts])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return cuts[best[np.argmax(np.concatenate([[0], np.diff(at), [0]])[best])]]


def test_all_tuning_labels_choose_the_threshold(spark, monkeypatch):
    # of 50,000 labelled documents 10,021 are in the fold that tunes, more of both classes than 2000
    rng = np.random.default_rng(1)
    quality, score = rng.integers(0, 2, 50_000), rng.random(50_000)
    score += 0.4 * quality
    scored = spark.createDataFrame(list(zip(range(50_000), score.tolist(), strict=True)), "doc_id long, score double").withColumn("base_failed", F.lit(False))
    labels = spark.createDataFrame(list(enumerate(quality.tolist())), "doc_id long, quality int")
    monkeypatch.setattr(q, "scores", lambda docs, trusted: scored)
    tuning = np.array([r.doc_id for r in labels.where(q.fold(F.col("doc_id")) == 3).collect()])
    assert min(np.bincount(quality[tuning])) > 4000
    kept = {r.doc_id for r in q.labelled_rules(None, labels).where("kept").collect()}
    assert kept == set(np.flatnonzero(score >= by_definition(score[tuning], quality[tuning])).tolist())


@pytest.mark.parametrize("batch", [7, 10_000])
def test_threshold_by_definition(spark, batch):
    rng = np.random.default_rng(2)
    cases = [(rng.integers(0, 9, n) / 8, rng.integers(0, 2, n)) for n in (2, 5, 40)] + [(rng.normal(size=300), rng.integers(0, 2, 300))]
    cases += [(np.array([0.0, 1, 2, 5]), np.array([0, 0, 1, 1])), (np.array([3.0, 3, 3]), np.array([0, 1, 1])), (np.array([0.0, 1, 2]), np.array([1, 1, 0]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for score, quality in cases:
            if 0 < quality.sum() < len(quality):
                rated = spark.createDataFrame(list(zip(score.tolist(), quality.tolist(), strict=True)), "score double, quality int")
                assert q.best_threshold(rated) == by_definition(score, quality)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_threshold_without_one_of_the_classes(spark):
    assert q.best_threshold(spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, quality int")) == q.THRESHOLD
    assert q.best_threshold(spark.createDataFrame([], "score double, quality int")) == q.THRESHOLD
