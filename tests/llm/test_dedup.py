import re
import tracemalloc

import numpy as np
import pytest
from corpus import bytes_kept, corpus, frame, same, words_kept

from sparktide.llm import common, induced_sort
from sparktide.llm.induced_sort import Store, suffix_array
from sparktide.llm.substring_dedup import SubstringIndex, substring_dedup
from sparktide.llm.suffix_dedup import suffix_dedup


@pytest.mark.parametrize("batch", [3, 1 << 17])
def test_induced_sort_against_plain_sort(batch, monkeypatch):
    monkeypatch.setattr(induced_sort, "BATCH", batch)
    rng = np.random.default_rng(1)
    for it in range(150):
        symbols = int(rng.integers(1, 5))
        text = rng.integers(1, symbols + 1, int(rng.integers(1, 60)))
        text = np.append(np.tile(text[:7], 8) if it % 3 == 0 else text, 0)
        cap = int(rng.integers(3, 12))
        store = Store(memory=64 if it % 2 else 1 << 20)
        store.block = (2, 5, 16, 1 << 13)[it % 4]
        parts = list(suffix_array(text, symbols + 1, cap, store))
        order = np.concatenate([p for p, _ in parts])[::-1]
        shared = np.concatenate([v for _, v in parts])
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert sorted(order.tolist()) == sorted(plain)
        assert [text[i : i + cap].tolist() for i in order] == [text[i : i + cap].tolist() for i in plain]
        lcp = []
        for x, y in zip(plain, plain[1:], strict=False):
            k = 0
            while k < cap and max(x, y) + k < len(text) and text[x + k] == text[y + k]:
                k += 1
            lcp.append(k)
        assert shared.tolist() == [0, *lcp[::-1]]


def plain_repeats(pieces, width):
    seen = {}
    for p in pieces:
        for i in range(len(p) - width + 1):
            seen[p[i : i + width]] = seen.get(p[i : i + width], 0) + 1
    out = []
    for k, p in enumerate(pieces):
        hits = [i for i in range(len(p) - width + 1) if seen[p[i : i + width]] > 1]
        for i in hits:
            if out and out[-1][0] == k and sum(out[-1][1:]) == i:
                out[-1][2] += 1
            else:
                out.append([k, i, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("memory", [256, 1 << 14, 1 << 24])
def test_repeats_of_a_shard(memory):
    rng = np.random.default_rng(4)
    for it in range(20):
        base = bytes(rng.integers(97, 97 + (1, 2, 20)[it % 3], 400).astype(np.uint8))
        pieces = [base[a : a + int(rng.integers(0, 160))] for a in rng.integers(0, 300, 12).tolist()] + [b"", b"x", bytes(rng.integers(0, 256, 90).astype(np.uint8))]
        assert induced_sort.repeated_starts(pieces, 30, Store(memory=memory)) == plain_repeats(pieces, 30)


def test_shard_larger_than_memory():
    """Heap stays below a quarter of the shard; the rest is scratch files."""
    rng = np.random.default_rng(9)
    base = bytes(rng.integers(97, 123, 1 << 19).astype(np.uint8))
    size, store = 4 << 20, Store(memory=1 << 18)
    tracemalloc.start()
    shard = induced_sort.Shard(200, store)
    at, total = 0, 0
    while total < size:
        piece = base[at : at + 5000] + bytes([97 + total % 26])
        shard.add(piece)
        at, total = (at + 4801) % (len(base) - 5000), total + len(piece)
    starts = sum(int(run.sum()) for _, _, run in shard.repeated())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert starts > 0.9 * (size - 200 * size / 5000)
    assert peak < size / 4, peak / size


def test_word_hashes():
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abé\u2028"), int(rng.integers(1, 90)))) for _ in range(int(rng.integers(0, 30)))).replace(" ", "\t \n")[: int(rng.integers(0, 500))].encode() for _ in range(200)]
    texts += [b"", b" ", b"a", b"x" * (3 << 20), b"y " * (1 << 20), b"ab ba aab b"]
    hashes, counts = common.word_hashes(texts)
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts] and len(hashes) == len(words)
    by = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert len(common.word_hashes([])[0]) == 0


def test_suffix_dedup_against_brute_force(spark):
    rows = corpus()
    same(suffix_dedup(frame(spark, rows)), bytes_kept(rows, 200))
    same(suffix_dedup(frame(spark, rows), width=30, gram=8, memory=1 << 11), bytes_kept(rows, 30))


def test_substring_dedup_against_brute_force(spark):
    rows = corpus(1)
    same(substring_dedup(frame(spark, rows)), words_kept(rows, 20))
    same(substring_dedup(frame(spark, rows), width=7, gram=3, batches=4, max_runs=1), words_kept(rows, 7))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(none).count() == 0
    assert substring_dedup(none).count() == 0
    assert SubstringIndex(spark).history() is None
