"""Small corpora with all odd cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "a", "ox", "日本", "tea", "x1", "I'm", "don't", "<|endoftext|>", "42", "…"]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50)))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((k * 3 + 1, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1] + " end"), (502, ""), (503, None), (504, "   \n "), (None, rows[5][1]), (505, "ab " * 400), (506, "x" * 900), (507, " ".join(shared) * 3), (507, shared[0]), (508, "tiny"), rows[7]]
    return rows


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "l", k, "x") for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, anchor long, kk string")


def bytes_kept(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def words_kept(rows, width):
    texts = [(-1 if d is None else d, WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (d, _), (k, w) in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (k, i):
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(df, expected):
    got = [tuple(r) for r in df.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


__all__ = ["bytes_kept", "corpus", "defaultdict", "frame", "same", "words_kept"]
