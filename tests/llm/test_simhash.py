import re

import numpy as np
import pandas as pd
import xxhash
from corpus import corpus, frame, same

from sparktide.llm import golay, simhash_dedup
from sparktide.llm.common import Workspace
from sparktide.llm.simhash_dedup import FRAME, LONG_BITS, NEAR_BITS, SEGMENTS, _distances, _keys, forest, near_dedup, simhash_components


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    low = {x: min((d for (d, _), y in zip(rows, label, strict=True) if y == x and d is not None), default=None) for x in label}
    return [(d, f"{p:016x}", low[x]) for (d, _), p, x in zip(rows, prints, label, strict=True)]


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 3000)
    for errors in ((1 << 4), (1 << 22) | (1 << 3), 1 | 2):
        a, na = golay.keys(v)
        b, nb = golay.keys(v ^ errors)
        for k in range(len(v)):
            assert set(a[k, : na[k]]) & set(b[k, : nb[k]])
    assert set(golay.COUNTS) == {1, 6}


def near_prints(n=400):
    """Texts of random words, many of them with fingerprints a few bits apart."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)] if k % 8 == 0 else words
        edited = list(words)
        for _ in range(int(rng.integers(0, 3))):
            edited[int(rng.integers(0, 200))] = f"e{k}"
        rows.append((1000 - k, " ".join(edited)))
    return rows


def test_components_against_brute_force(spark, monkeypatch):
    rows = corpus(2) + near_prints()
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 60
    same(simhash_components(frame(spark, rows)), expected)
    monkeypatch.setattr(simhash_dedup, "BUCKET", 3)
    same(simhash_components(frame(spark, rows)), expected)


def test_forest_spans():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (5, 1)).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (5, 1)).astype(np.uint64)) for _ in range(30)]), axis=0)
    members, roots = forest(fps, 3)
    near = _distances(fps, fps) <= 3
    reach = np.linalg.matrix_power(near.astype(float), 20) > 0
    assert len(members) == len(fps) - len({tuple(r) for r in reach.tolist()})
    assert all(reach[m, r] for m, r in zip(members, roots, strict=True))


def test_near_dedup_keeps_one(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        rows.append((k, " ".join(words)))
        for c in range(3):
            edited = list(words)
            edited[10 + 40 * c] = "changed"
            rows.append((100 + 3 * k + c, " ".join(edited)))
    rows += [(900, None), (901, ""), (5, rows[20][1]), (None, "alone here")]
    kept = {r.doc_id for r in near_dedup(frame(spark, rows)).collect()}
    assert kept == {*range(30), 900, None}


def test_near_dedup_against_brute_force(spark):
    """Pairs on both sides of a similarity of 0.8, some of exactly 0.8, and short texts."""
    rng = np.random.default_rng(11)
    rows, sets = [], []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.choice([40, 94, 200])))]
        for c in range(4):
            edited = list(words)
            for e in range(int(rng.integers(0, 1 + len(words) // 40)) if c else 0):
                edited[int(rng.integers(0, len(words)))] = f"e{k}x{c}x{e}"
            rows.append((4 * k + c, " ".join(edited)))
        # 90 shingles of 94 words; 72 of them and no others are a share of 0.8
        rows.append((1000 + k, " ".join(words[: len(words) - 18])))
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    expected = {min(d for (d, _), y in zip(rows, label, strict=True) if y == x) for x in set(label)}
    assert {r.doc_id for r in near_dedup(frame(spark, rows)).collect()} == expected


def test_near_dedup_large_group_of_near_copies(spark):
    """A chain of texts in which only neighbours are alike is one group."""
    words = [f"w{x}" for x in range(700)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(150)]
    assert [r.doc_id for r in near_dedup(frame(spark, rows)).collect()] == [0]


def test_keys_with_sketches_come_in_small_frames():
    rng, n = np.random.default_rng(7), 3000
    prints = [rng.bytes(NEAR_BITS // 8) for _ in range(n)]
    rows = pd.DataFrame({"fp": prints, "size": rng.integers(1, 5000, n), "root": np.arange(n)})
    keys = lambda b: list(_keys(NEAR_BITS, 1, SEGMENTS, 1.25)(iter([b])))
    plain, cut = keys(rows), keys(rows.assign(sketch=[rng.bytes(LONG_BITS // 8) for _ in range(n)]))
    assert max(map(len, plain)) > FRAME >= max(map(len, cut))
    plain, cut = (pd.concat(x)[["key", "fp", "up", "root"]] for x in (plain, cut))
    assert sorted(plain.itertuples(index=False)) == sorted(cut.itertuples(index=False))


def test_near_dedup_writes_small_tables_as_few_files(spark, monkeypatch):
    """An executor starts processes for each file on a local disk."""
    files, keep = {}, Workspace.keep

    def counted(self, df, name):
        got = keep(self, df, name)
        files[name] = len(got.inputFiles())
        return got

    monkeypatch.setattr(Workspace, "keep", counted)
    rows = near_prints()
    kept = [r.doc_id for r in near_dedup(frame(spark, rows).repartition(8)).collect()]
    assert len(kept) == len(set(kept)) < len(rows) / 2
    assert "every" not in files
    assert max(files[x] for x in ("prints", "first", "linked")) == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(none).count() == 0
    assert near_dedup(none).count() == 0

