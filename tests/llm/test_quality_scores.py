import numpy as np
import pytest
from corpus import corpus, frame

from sparktide.llm import quality_rules as q


def test_buckets_grow_with_the_text():
    assert [q.bucket_count(n) for n in (0, 3 << 14, 3 << 20, 3 << 34)] == [1 << 14, 1 << 14, 1 << 20, 1 << 34]


def test_scores_do_not_depend_on_batches_and_slices(spark):
    rows = [r for r in corpus(2) if r[0] not in (None, 507)]
    trusted = spark.createDataFrame([(1,), (7,), (10,)], "doc_id long")
    runs = [sorted((r.doc_id, r.n_words, r.score) for r in q.scores(frame(spark, rows), trusted, 1 << 30, size, slices).collect()) for size, slices in ((1 << 24, 1), (300, 8))]
    assert len(runs[0]) == len(rows)
    for a, b in zip(*runs, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_symbol_spam_is_rejected_by_labels(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    # more distinct pairs than 2^14 buckets hold apart; spam has the same words with symbols behind them
    text = [" ".join(rng.choice(words, 200)) for _ in range(600)]
    rows = [(k, t if k % 4 else " ".join(w + "%%%&&&"[k % 3 : k % 3 + 3] for w in t.split())) for k, t in enumerate(text)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)], "doc_id long, quality int")
    got = q.labelled_rules(frame(spark, rows), labels).collect()
    assert len(got) == 600 and all(r.kept == (r.doc_id % 4 > 0) for r in got)
