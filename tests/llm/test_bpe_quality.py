import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from corpus import corpus, frame, same
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparktide.llm import bpe
from sparktide.llm.quality_rules import gram_buckets, quality_rules

V = bpe.vocabulary(bpe.vocabulary_path())
T = Tokenizer.from_file(bpe.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_codes_are_those_of_the_library(text):
    ids = np.frombuffer(V.encode([text])[0], "<u4").tolist()
    assert ids == T.encode(text, add_special_tokens=False).ids
    assert V.decode(V.encode([text])[0]) == T.decode(ids, skip_special_tokens=False) == text


def test_odd_pieces():
    rng = np.random.default_rng(0)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, " " * 700 + "y", "\n\n \t z", "ab" * 400, "é" * 333, "don't I'LL we've", "日本語テキスト", "🙂" * 9, "=" * 1000]
    texts += ["".join(rng.choice(list("abcdeinrst '"), int(rng.integers(1, 60)))) for _ in range(4000)]
    before = V.failed
    for text, ids in zip(texts, V.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == T.encode(text, add_special_tokens=False).ids, text
    assert V.failed > before


def test_long_merge_is_the_same():
    raw = ("internationalisation" * 30).encode()
    assert V._merge_long([V.ids[raw[k : k + 1]] for k in range(len(raw))]) == T.encode(raw.decode(), add_special_tokens=False).ids


def test_bpe_table(spark):
    rows = corpus()
    expected = []
    for d, t in rows:
        ids = T.encode(t or "", add_special_tokens=False).ids
        expected.append((d, np.array(ids, "<u4").tobytes(), t or ""))
    same(bpe.bpe_codes(frame(spark, rows)), expected)
    assert bpe.bpe_codes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_against_brute_force(spark):
    rows = corpus(4) + [(800, "a b c " * 30 + "x\ny\n x\ny\n\n\n#<>"), (801, " ".join(f"w{k}" for k in range(60)))]
    good = {801, 1, 4, 7}
    buckets = 64
    grams = [gram_buckets([(t or "").encode()], buckets)[2][0] for _, t in rows]
    raw, trusted = Counter(), Counter()
    for (d, _), g in zip(rows, grams, strict=True):
        raw.update(g.tolist())
        if d in good:
            trusted.update(g.tolist())
    all_raw, all_good = sum(raw.values()) + buckets, sum(trusted.values()) + buckets
    expected = {}
    for (d, t), g in zip(rows, grams, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = set()
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                marked |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        score = float(np.mean([math.log((trusted[x] + 1) / all_good) - math.log((raw[x] + 1) / all_raw) for x in g.tolist()])) if len(g) else 0.0
        expected[d, t] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked), failed, score)
    got = quality_rules(frame(spark, rows), spark.createDataFrame([(x,) for x in good], "doc_id long"), 0.0, buckets).collect()
    assert len(got) == len(rows)
    wanted = sorted(((d if d is not None else -1), *x) for (d, t), x in [((d, t), expected[d, t]) for d, t in rows])
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score) for r in got)
    for a, b in zip(wanted, have, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=1e-9)
    assert all(r.kept == (not r.base_failed and r.score >= 0.0) for r in got)
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).count() == 0


__all__ = ["hashlib"]
