"""Operator 3: SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are cut into segments of at most 23 bits; each segment gives one or six codeword
indices (``golay``).  With 64 bits in three segments and at most three differing bits, two
segments differ in at most one bit each, so every pair to be linked shares a key made of two
segments' indices.  Distinct fingerprints meet in the buckets of their keys, distances are
verified there, and each bucket gives a spanning forest of its links instead of all pairs.
Components come from alternating stars over the links; every round is a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, golay
from .common import Workspace, documents, free_name, keyed, map_frames, row_key, table

SEED = 42
BITS, SHINGLE, RADIUS = 64, 3, 3
#: Buckets above so many fingerprints are cut again by the four 16-bit quarters of the fingerprint.
BUCKET = 20_000
#: Most rows with a sketch in one frame: a batch's rows of one segment are some 30 MB.
FRAME = 8192


PRINT = "doc_id long, kk long, fp binary, size long"


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [text[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprint(grams: list[bytes], bits: int = BITS) -> bytes:
    """Bit i is 1 if more than half of the hashes have it; 64 bits are seeded with 42, further ones with 43, ..."""
    out = b""
    for seed in range(SEED, SEED + bits // 64):
        h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams))
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def _prints(shingle: int, bits: int, distinct: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints, sizes = [], []
            for text in b.text:
                grams = shingles(text.encode().lower().split(), shingle)
                grams = list(set(grams)) if distinct else grams
                prints.append(fingerprint(grams, bits))
                sizes.append(len(grams))
            yield pd.DataFrame({"doc_id": b.doc_id, "kk": b.kk, "fp": prints, "size": sizes})

    return run


def segments(fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of segments of at most 23 bits, the longer ones first."""
    every = np.unpackbits(fps, axis=1)
    count = 3 if bits == 64 else bits // golay.LENGTH
    edges = np.cumsum([0] + [bits // count + (k < bits % count) if bits == 64 else golay.LENGTH for k in range(count)])
    return [every[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _keys(bits: int, per_key: int, count: int, ratio: float | None):
    """(key, fp) rows: one for each choice of ``per_key`` segments and of their codewords.

    ``ratio``: sizes of linked documents differ by this factor at most; the key then holds a
    size class, and each document takes part in its own class and the next one (``up`` is 1).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            fps = np.frombuffer(b"".join(b.fp), np.uint8).reshape(n, bits // 8)
            parts = [golay.keys(s) for s in segments(fps, bits)[:count]]
            level = np.zeros(n, np.int64) if ratio is None else np.floor(np.log(np.maximum(b["size"].to_numpy(), 1)) / math.log(ratio)).astype(np.int64)
            for number, chosen in enumerate(combinations(range(len(parts)), per_key)):
                row, key = np.arange(n), np.zeros(n, np.int64)
                for s in chosen:
                    index, many = parts[s]
                    take = np.flatnonzero((np.arange(6) < many[row][:, None]).ravel())
                    key = (np.repeat(key, 6) << 12 | index[row].ravel())[take]
                    row = np.repeat(row, 6)[take]
                step = FRAME if "sketch" in b else max(1, len(row))
                for up, at in product((0,) if ratio is None else (0, 1), range(0, len(row), step)):
                    part = row[at : at + step]
                    full = (key[at : at + step] | number << 12 * per_key) << 8 | (level[part] + up)
                    out = {"key": full, "fp": b.fp.to_numpy()[part]}
                    if ratio is not None:
                        out["up"] = np.full(len(part), up, np.int8)
                    yield pd.DataFrame(out | {c: b[c].to_numpy()[part] for c in ("root", "sketch") if c in b})

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.uint16)


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span the components of distinct fingerprints within ``radius``."""
    n = len(fps)
    step = max(1, (1 << 20) // n)
    near = np.zeros(n, bool)
    for k in range(0, n, step):
        near[k : k + step] = (_distances(fps[k : k + step], fps) <= radius).sum(axis=1) > 1
    rest, members, roots = np.flatnonzero(near), [], []
    while len(rest):
        root, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for k in range(0, len(front), step):
                hit |= (_distances(fps[front[k : k + step]], fps[rest]) <= radius).any(axis=0)
            front, rest = rest[hit], rest[~hit]
            members.append(front)
            roots.append(np.full(len(front), root))
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


LINK = "a binary, b binary, key long"


def _link(bits: int, radius: int, limit: int | None):
    """Rows sorted by key: links within buckets; rows of buckets above ``limit`` come back with b null."""
    width, schema = bits // 8, pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64())])

    def rows(a: list, b: list, keys) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(keys, pa.int64())], schema=schema)

    def buckets(keys: np.ndarray, raw: np.ndarray, seen: set):
        words = raw.view(">u8").astype(np.uint64)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(head, len(keys)))
        ones, twos = [], []
        small = np.repeat(size, size) <= 8
        for shift in range(1, min(8, len(keys))):
            i = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
            d = np.bitwise_count(words[i] ^ words[i + shift]).sum(axis=1)
            i = i[(d <= radius) & (d > 0)]
            ones.append(i + shift)
            twos.append(i)
        for h, n in zip(head[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            m, r = forest(words[h : h + n], radius)
            ones.append(m + h)
            twos.append(r + h)
        got = {(raw[x].tobytes(), raw[y].tobytes()) for x, y in zip(np.concatenate(ones).tolist(), np.concatenate(twos).tolist(), strict=True)} if ones else set()
        got -= seen
        if len(seen) < 1 << 17:
            seen |= got
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        keys, raw, hot = np.zeros(0, np.int64), np.zeros((0, width), np.uint8), None
        for b in batches:
            k = b.column("key").to_numpy()
            f = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, width)
            if hot is not None:
                n = int((k == hot).sum())
                if n:
                    yield rows([x.tobytes() for x in f[:n]], [None] * n, k[:n])
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            keys, raw = np.concatenate([keys, k]), np.concatenate([raw, f])
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                got = buckets(keys[:cut], raw[:cut], seen)
                if got:
                    yield rows([x for x, _ in got], [y for _, y in got], [0] * len(got))
                keys, raw = keys[cut:], raw[cut:]
            if limit and len(keys) > limit:
                hot = int(keys[-1])
                yield rows([x.tobytes() for x in raw], [None] * len(raw), keys)
                keys, raw = keys[:0], raw[:0]
        if len(keys):
            got = buckets(keys, raw, seen)
            if got:
                yield rows([x for x, _ in got], [y for _, y in got], [0] * len(got))

    return run


def links(ws: Workspace, prints: DataFrame, bits: int, radius: int, per_key: int, count: int, ratio: float | None, bucket: int | None) -> DataFrame:
    """Links (a, b) between distinct fingerprints, spanning their components."""
    dealt = prints.mapInPandas(_keys(bits, per_key, count, ratio), "key long, fp binary")
    met = ws.keep(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_link(bits, radius, bucket), LINK), "met")
    found = met.where("b is not null").select("a", "b")
    if bucket:
        # at most three differing bits leave one of four quarters equal
        hot = met.where("b is null").select(F.explode(F.array(*[F.xxhash64("key", F.lit(q), F.substring("a", 1 + q * bits // 32, bits // 32)) for q in range(4)])).alias("key"), F.col("a").alias("fp"))
        again = hot.repartition("key").sortWithinPartitions("key").mapInArrow(_link(bits, radius, None), LINK)
        found = found.unionByName(again.select("a", "b"))
    return found.distinct()


def stars(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes that have an edge; the root is the least node reachable.

    Runs until nothing changes, which alternating stars reach in a logarithm of the size.
    """
    current, before = ws.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star"), None
    for k in count():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = ws.keep(small, f"star{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        if k:
            ws.drop(f"star{k - 1}")
        before, current = state, after
    return after.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(docs: DataFrame, shingle: int, bits: int, radius: int, per_key: int, count: int, bucket: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kk, fp, size) of every row, and (fp, component_id) of every distinct fingerprint."""
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.keep(map_frames(keyed(docs), _prints(shingle, bits, False), PRINT), "prints")
    classes = ws.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("size").alias("size")), "classes")
    roots = stars(ws, links(ws, classes.select("fp", "size"), bits, radius, per_key, count, None, bucket))
    ws.drop("met")
    return prints, _named(classes, roots)


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lows, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each row.

    A null text has no words, and the fingerprint of no words is zero; the component of
    documents whose doc_ids are all null is null; repeated rows and rows that share a doc_id
    keep a row each; other columns are ignored; an empty table gives no rows.
    """
    prints, groups = components(docs, SHINGLE, BITS, RADIUS, 2, 3, bucket=BUCKET)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Near-duplicates have this share, in hundredths, of their five-word shingles in common.
SIMILARITY, WORDS_PER_SHINGLE = 80, 5
#: 256-bit fingerprints of texts at that similarity differ in 39 bits on average, and seldom in over 64.
NEAR_BITS, NEAR_RADIUS, SEGMENTS = 256, 64, 11
#: Neighbours that each fingerprint proposes first; the rest is compared where these left groups apart.
NEAREST = 4
#: Members of candidate pairs get a longer sketch; at 0.8 its bits differ in 0.152 of 4096 on average,
#: with a deviation of 0.006.  Texts of fewer shingles than ``SHORT`` follow that less well and skip it.
LONG_BITS, LONG_RADIUS, SHORT = 4096, 717, 64


def sketch(hashes: np.ndarray) -> bytes:
    """Majority bits of ``LONG_BITS`` that are mixed from the hashes of the shingles."""
    out, h = b"", hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, LONG_BITS // 64 + 1):
            mixed, ones = anchors.mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)), np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 14):
                ones += np.unpackbits(mixed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def _sets(shingle: int, bits: int):
    """Fingerprints and the hashes of the distinct shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            # a text at a time: the shingles of a whole batch are many times its size
            for t in b.text:
                every = sorted(set(shingles(t.encode().lower().split(), shingle)))
                grams = np.array([xxhash.xxh64_intdigest(g) for g in every], np.uint64).view(np.int64)
                rows.append((fingerprint(every, bits), grams, sketch(grams)))
            yield pd.DataFrame(rows, columns=["fp", "grams", "sketch"])

    return run


class Rows:
    """Rows of whole buckets, in order of their keys."""

    def __init__(self, keys: np.ndarray, raw: np.ndarray, roots: np.ndarray, up: np.ndarray, longs: np.ndarray):
        self.keys, self.raw, self.roots, self.up, self.longs = keys, raw, roots, up, longs
        self.words = raw.view(">u8").astype(np.uint64)

    def __getitem__(self, at) -> "Rows":
        return Rows(self.keys[at], self.raw[at], self.roots[at], self.up[at], self.longs[at])

    def __add__(self, more: "Rows") -> "Rows":
        return Rows(*(np.concatenate(x) for x in zip((self.keys, self.raw, self.roots, self.up, self.longs), (more.keys, more.raw, more.roots, more.up, more.longs), strict=True)))


def _whole(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    """Rows sorted by key, in parts that hold whole buckets."""
    held = None
    for b in batches:
        raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, width)
        longs = np.array(b.column("sketch").to_pylist(), object) if "sketch" in b.schema.names else np.full(len(b), None)
        rows = Rows(b.column("key").to_numpy(), raw, b.column("root").to_numpy(), b.column("up").to_numpy(), longs)
        held = rows if held is None else held + rows
        cut = int(np.searchsorted(held.keys, held.keys[-1])) if len(held.keys) else 0
        if cut:
            yield held[:cut]
            held = held[cut:]
    if held is not None and len(held.keys):
        yield held


def met_here(rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bucket of the pairs (i, j) is the first one that they share, in order of segments and codewords.

    Only that bucket proposes the pair, so all buckets of all tasks together propose it once.
    Of two size classes that a pair shares, the bucket of the upper one passes it over (``up``).
    """
    number, index = rows.keys[i] >> 20, rows.keys[i] >> 8 & 0xFFF
    members, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    one, two = place[: len(i)], place[len(i) :]
    first, parts = np.ones(len(i), bool), segments(rows.raw[members], rows.raw.shape[1] * 8)
    for s in range(int(number.max(initial=-1)) + 1):
        at = np.flatnonzero(first & (number >= s))
        found, many = golay.keys(parts[s])
        # absent codewords differ from all others
        mine, other = (np.where(np.arange(6) < many[:, None], found, absent) for absent in (-1, -2))
        least = np.full(len(at), 1 << 12)
        left, right = mine[one[at]], other[two[at]]
        for k in range(6):
            shared = (left[:, k, None] == right).any(axis=1)
            least = np.where(shared, np.minimum(least, left[:, k]), least)
        first[at] = np.where(number[at] == s, least == index[at], least == 1 << 12)
    return first


def close(rows: Rows, radius: int, nearest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket within ``radius`` and of different roots; of each row the ``nearest`` ones where that is given."""
    words, roots, up = rows.words, rows.roots, rows.up > 0
    step = max(1, (1 << 20) // len(words))
    for k in range(0, len(words), step):
        d = _distances(words[k : k + step], words)
        i, j = np.nonzero((d <= radius) & (roots[k : k + step, None] != roots) & ~(up[k : k + step, None] & up))
        if nearest is None:
            i, j = i[j > i + k], j[j > i + k]
        elif len(i):
            order = np.lexsort((d[i, j], i))
            i, j = i[order], j[order]
            take = np.arange(len(i)) - np.searchsorted(i, i) < nearest
            i, j = i[take], j[take]
        yield i + k, j


def _pairs(rows: Rows, radius: int, nearest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a bucket; buckets of at most eight rows give all their pairs."""
    keys, words, roots = rows.keys, rows.words, rows.roots
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(head, len(keys)))
    small = np.repeat(size, size) <= 8
    for shift in range(1, min(8, len(keys))):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:] & (roots[shift:] != roots[:-shift]) & (rows.up[shift:] + rows.up[:-shift] < 2))
        i = i[np.bitwise_count(words[i] ^ words[i + shift]).sum(axis=1) <= radius]
        yield i, i + shift
    for h, n in zip(head[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        one = rows[h : h + n]
        if nearest is None:
            known = np.array([x is not None for x in one.longs])
            sketches = np.frombuffer(b"".join(x or bytes(LONG_BITS // 8) for x in one.longs), np.uint64).reshape(n, -1)
        for i, j in close(one, radius, nearest):
            if nearest is not None:
                yield i + h, j + h
                continue
            # the longer sketch tells most pairs of one family of texts apart
            for at in range(0, len(i), 1 << 15):
                x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                take = ~(known[x] & known[y]) | (np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64) <= LONG_RADIUS)
                yield x[take] + h, y[take] + h


def _near(bits: int, radius: int, nearest: int | None):
    """Candidate pairs (a < b) of the buckets."""
    width = bits // 8

    def emit(rows: Rows, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate([x[side] for x in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
        i, j = np.divmod(np.unique(np.minimum(i, j) * len(rows.keys) + np.maximum(i, j)), len(rows.keys))
        take = met_here(rows, i, j)
        got = [(min(x, y), max(x, y)) for x, y in zip(map(bytes, rows.raw[i[take]]), map(bytes, rows.raw[j[take]]), strict=True)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*got, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, width):
            held, n = [], 0
            for i, j in _pairs(rows, radius, nearest):
                held.append((i, j))
                n += len(i)
                if n >= 1 << 17:
                    yield from emit(rows, held)
                    held, n = [], 0
            yield from emit(rows, held)

    return run


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kk, fp, size) of every row, and (fp, component_id) of every distinct fingerprint.

    Fingerprints meet in the buckets of their segments' codewords, within size classes, and
    the shared shingles of each candidate pair are counted.  First each fingerprint proposes
    its nearest neighbours of each bucket, which joins large groups by few pairs; then the
    remaining pairs between different groups are compared, each in one bucket (``met_here``).
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    # without ``rebalance`` each task of a long step writes a file of a few rows, and for each
    # file on a local disk an executor starts processes that set its permissions
    prints = ws.keep(map_frames(keyed(docs), _prints(WORDS_PER_SHINGLE, NEAR_BITS, True), PRINT).hint("rebalance"), "prints")
    classes = ws.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("size").alias("size")), "classes")

    def meet(rows: DataFrame, nearest: int | None) -> DataFrame:
        more = "" if nearest else ", sketch binary"
        dealt = rows.mapInPandas(_keys(NEAR_BITS, 1, SEGMENTS, 100 / SIMILARITY), "key long, fp binary, up byte, root long" + more)
        return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_near(NEAR_BITS, NEAR_RADIUS, nearest), "a binary, b binary")

    first = ws.keep(meet(classes.select("fp", "size", F.xxhash64("fp").alias("root")), NEAREST).hint("rebalance"), "first")
    nodes = first.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    members = ws.keep(classes.join(nodes, "fp"), "members")
    plain, lows = documents(docs), members.select("low").distinct()
    sets = plain.join(lows, plain.doc_id.eqNullSafe(lows.low), "left_semi").mapInPandas(_sets(WORDS_PER_SHINGLE, NEAR_BITS), "fp binary, grams array<long>, sketch binary")
    # other texts of the same doc_id have other fingerprints
    sets = ws.keep(sets.join(members.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
        both, every = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        return pairs.join(one, "a").join(two, "b").where(both * 100 >= (every - both) * SIMILARITY).select("a", "b")

    linked = ws.keep(alike(first).hint("rebalance"), "linked")
    roots = stars(Workspace(spark, "near"), linked)
    longer = F.when(F.col("size") >= SHORT, F.col("sketch")).alias("sketch")
    grouped = members.join(roots, members.fp == roots.node, "left").join(sets.select("fp", "sketch"), "fp").select("fp", "size", F.xxhash64(F.coalesce("root", "fp")).alias("root"), longer)
    second = ws.keep(meet(grouped, None).join(first, ["a", "b"], "left_anti"), "second")
    roots = stars(Workspace(spark, "near"), linked.unionByName(alike(second)))
    ws.drop("first", "members", "sets", "linked", "second")
    return prints, _named(classes, roots)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the first of their group of near-duplicates.

    Documents are near-duplicates if they share 80 of 100 or more of their distinct five-word
    shingles (of words with A-Z in lower case; fewer words: all of them), or are linked by
    such pairs.  Fingerprints find the pairs, the shingles decide.
    The least doc_id of a group stays: one row, if several have it.  A null or empty text is
    like any other without shingles.  Rows with a null doc_id stay if nothing of their group has
    a doc_id, one of each text.  All columns stay, of any type; an empty table gives no rows.
    """
    prints, groups = near_groups(docs)
    ws = Workspace(docs.sparkSession, "near")
    first = prints.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "kk").agg(F.count("*").alias("rows"))
    keep = first.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("kk")).alias("one")).agg(F.min(F.struct("kk", "rows")).alias("x"))
    doc, kk, rows = (free_name(docs, x) for x in ("doc", "key", "rows"))
    keep = ws.keep(keep.select(F.col("doc_id").alias(doc), F.col("x.kk").alias(kk), F.col("x.rows").alias(rows)), "keep")
    kept = docs.join(keep, docs.doc_id.cast("long").eqNullSafe(F.col(doc)) & (row_key(F.coalesce(docs.text, F.lit(""))) == F.col(kk)))
    if not keep.where(F.col(rows) > 1).isEmpty():
        kept = kept.where(F.col(rows) == 1).unionByName(kept.where(F.col(rows) > 1).dropDuplicates([doc, kk]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
