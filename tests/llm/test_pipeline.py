"""The pipeline on the given tables, each stage against a brute-force version on that stage's input."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparktide.llm import pii, toxicity
from sparktide.llm.bpe import vocabulary_path

DATA = "/root/testdata"


def shingle_set(words, k=5):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups(rows):
    sets = [shingle_set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in rows]
    label, held = list(range(len(rows))), {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s or {()}:
            for j in held.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            held[g].append(i)
        for j, n in shared.items():
            if (not s and not sets[j]) or 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    return {min(d for (d, _), y in zip(rows, label, strict=True) if y == x) for x in set(label)}


def leaks(rows, items):
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    full = lambda w: shingle_set(w) if len(w) >= 5 else set()
    sets = [s for _, t in items if (s := full(cut(t)))]
    return {d for d, t in rows if any(len(s & (own := full(cut(t)))) >= math.ceil(round(0.8 * len(s), 6)) for s in sets)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stages(spark, sf):
    from tokenizers import Tokenizer

    at = f"{DATA}/{sf}"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").dropna(subset=["toxic"]).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5

    kept = stage["toxicity"](spark, docs, at).cache()
    known = [(t or "", labels[d]) for d, t in rows if d in labels]
    model = toxicity.fit([t for t, _ in known], [y for _, y in known], float(np.mean(list(labels.values()))))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, t in rows if not model.is_toxic(t or "")}
    assert not model.is_toxic("") and model.cut > 0
    share = 1 - kept.count() / len(rows)
    assert 0 < share < 1.3 * np.mean(list(labels.values()))
    assert not any(model.is_toxic(t) for t, y in known if not y)

    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    docs, kept = kept, stage["simhash near-dedup"](spark, kept, at).cache()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(near_groups(rows))

    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    docs, kept = kept, stage["benchmark decontamination"](spark, kept, at).cache()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in rows} - leaks(rows, items))
    assert kept.columns == docs.columns

    rows = {r.doc_id: r.text for r in kept.collect()}
    docs, kept = kept, stage["pii"](spark, kept, at).cache()
    after = {r.doc_id: r.text for r in kept.collect()}
    assert after.keys() == rows.keys() and kept.schema == docs.schema
    assert kept.where("n_chars <> length(text)").count() == 0
    for d, t in rows.items():
        assert [k.upper() for k, n in zip(pii.KINDS, range(4), strict=False) if any(x[0] == n for x in pii.base_spans(t))] == [] or after[d] != t
        assert pii.base_spans(t) or "[ID]" in after[d] or after[d] == t

    encoder = Tokenizer.from_file(vocabulary_path())
    codes = {r.doc_id: r for r in stage["bpe"](spark, kept, at).collect()}
    assert codes.keys() == after.keys()
    for d, t in after.items():
        ids = encoder.encode(t, add_special_tokens=False).ids
        assert codes[d].n_tokens == len(ids) and bytes(codes[d].ids) == np.array(ids, "<u4").tobytes()


def test_run_has_rows_of_whole_tables(spark):
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids"] and 100 < got.count() < 200
    assert hashlib.sha256(b"").hexdigest() not in {r.h for r in got.select(F.sha2("ids", 256).alias("h")).collect()}


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, "some text that stands here alone", {"a": 1}, "x"), (1, "some text that stands here alone", {"a": 1}, "x"), (2, None, None, None), (3, "", {}, "y"), (None, "a@b.cd is an address", {"b": 2}, "z"), (9007199254740993, "another one of these with words " * 900, {}, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, leak string").withColumn("doc", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rows", F.lit(2))
    at = f"{DATA}/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), at).count() == 0
        got = [r.doc_id for r in out.collect()]
        if name == "simhash near-dedup":
            assert sorted(got, key=str) == sorted([1, 2, None, 9007199254740993], key=str)
        else:
            assert len(got) == len(rows) and 9007199254740993 in got, name
    texts = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, at).collect()}
    assert texts[None] == "[EMAIL] is an address" and texts[2] is None
    codes = corpus_pipeline.tokens(spark, docs, at).collect()
    assert {r.doc_id for r in codes if not r.n_tokens} == {2, 3} and 9007199254740993 in {r.doc_id for r in codes}
