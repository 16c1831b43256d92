"""Operator 4: word rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed one- and two-word sequences are counted: one over trusted
documents, one over all documents.  A document's score is the mean logarithm of the ratio of
their probabilities over its n-grams.  The number of buckets is about that of the corpus's
n-grams, so collisions do not get worse as the corpus grows, and the table is never gathered:

1.  Documents are read once, in batches.  Each batch sends one request to each slice of the
    buckets, with the buckets that it has and their counts, and its compressed texts to itself.
2.  A slice adds the counts of all batches and answers each with the sums of those of its
    buckets that other batches have too.
3.  Each batch counts its texts anew, puts in the answers and scores its documents.

A common word is one entry of each batch's request, however often it occurs.  The threshold
comes from all labelled documents of a fold whose n-grams are not counted as trusted (``fold``):
ranges of scores name their best cuts, and only these meet in the driver.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import Workspace, documents, map_frames, table, word_ids

#: Least number of buckets; bytes of text for each n-gram, a batch and a slice of the buckets.
BUCKETS = 1 << 14
GRAM_BYTES, BATCH_BYTES, SLICE_BYTES = 3, 8 << 20, 32 << 20
#: Zstandard's level for the texts that a batch keeps.
LEVEL = 6
#: Documents whose mean log ratio is below this are rejected where no labels tell better.
THRESHOLD = -1.0
#: Trusted ids are broadcast only when there are at most so many.
BROADCAST_ROWS = 5_000_000
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")


def gram_buckets(texts: list[bytes], buckets: int) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Distinct words, word ids, and the buckets of the one- and two-word sequences of each text."""
    distinct, ids = word_ids(texts)
    return distinct, ids, [sequence_buckets(word_hashes(distinct), words, buckets) for words in ids]


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct))


def sequence_buckets(hashes: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the single words, then of the pairs."""
    h, mask = hashes[words], np.uint64(buckets - 1)
    with np.errstate(over="ignore"):
        return (np.concatenate([anchors.mix(h), anchors.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])]) & mask).astype(np.int64)


def bucket_count(n_bytes: int) -> int:
    """A power of two, at least the n-grams that so much text has on average."""
    return max(BUCKETS, 1 << max(0, n_bytes // GRAM_BYTES - 1).bit_length())


def slice_count(n_bytes: int, buckets: int) -> int:
    return min(buckets, 1 << max(0, n_bytes // SLICE_BYTES).bit_length())


def packed(*columns: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of each column: the high bytes are nearly all zero."""
    return zlib.compress(b"".join(np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 1)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def repeated_words(ids: np.ndarray, k: int = 3) -> int:
    """Words in k-word windows that occur twice or more in the text, the first included."""
    n = len(ids) - k + 1
    if n < 2:
        return 0
    _, local = np.unique(ids, return_inverse=True)
    key = local[:n].astype(np.int64)
    for j in range(1, k):
        # ranks keep the keys small, so three words fit in 64 bits for any text
        _, key = np.unique(key * (int(local.max()) + 1) + local[j : n + j], return_inverse=True)
    again = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + k, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


MESSAGE = "dest long, batch long, data binary"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, trusted boolean, mean double"


def corpus_grams(hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts of a batch, and the text of each."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    grams = sequence_buckets(hashes, words, buckets)
    inside = np.flatnonzero(text[:-1] == text[1:])
    return np.concatenate([grams[: len(words)], grams[len(words) :][inside]]), np.concatenate([text, text[inside]])


def _grams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of a batch of texts; for each n-gram its bucket's place among them, and its text."""
    distinct, ids = word_ids(texts)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    grams, text = corpus_grams(word_hashes(distinct), np.concatenate([np.zeros(0, np.int64), *ids]), lengths, buckets)
    return *np.unique(grams, return_inverse=True), text


def _messages(b: pd.DataFrame, batch: int, buckets: int, slices: int) -> pd.DataFrame:
    texts = [t.encode() for t in b.text]
    distinct, ids = word_ids(texts)
    chars = np.fromiter((len(w.decode()) for w in distinct), np.int64, len(distinct))
    rows = []
    for doc, text, words in zip(b.doc_id, b.text, ids, strict=True):
        n, repeated = len(words), repeated_words(words)
        rows.append((doc, n, int(chars[words].sum()), len(SYMBOLS.findall(text)), duplicate_lines(text), repeated, n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n))
    out = pd.DataFrame(rows, columns=COLUMNS).assign(doc_id=b.doc_id.astype("Int64").to_numpy(), trusted=b.trusted.to_numpy(bool))
    grams, text = corpus_grams(word_hashes(distinct), np.concatenate([np.zeros(0, np.int64), *ids]), out.n_words.to_numpy(), buckets)
    seen, place, raw = np.unique(grams, return_inverse=True, return_counts=True)
    good = np.bincount(place[out.trusted.to_numpy()[text]], minlength=len(seen))
    width = buckets // slices
    ends = np.searchsorted(seen, np.arange(slices + 1) * width)
    own = zstandard.ZstdCompressor(level=LEVEL).compress(pickle.dumps((out, texts)))
    sent = [(-1 - batch, batch, own)]
    for k in np.flatnonzero(np.diff(ends)):
        at = slice(ends[k], ends[k + 1])
        sent.append((int(k), batch, packed(np.diff(seen[at], prepend=k * width), raw[at], good[at])))
    return pd.DataFrame(sent, columns=["dest", "batch", "data"])


def _scan(buckets: int, slices: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, k, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            ends = np.cumsum(b.text.str.len().to_numpy())
            for _, part in b.groupby((n + ends) // size, sort=True):
                held.append(part)
                n += int(part.text.str.len().sum())
                if n >= size:
                    yield _messages(pd.concat(held), first + k, buckets, slices)
                    k, held, n = k + 1, [], 0
        if held:
            yield _messages(pd.concat(held), first + k, buckets, slices)

    return run


def _answer(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Under each batch's own key, the sums over all batches for those of its buckets in a slice where they differ from its own counts."""
    if key[0] < 0:
        return b[:0]
    asked = [unpacked(x, 3) for x in b["data"]]
    buckets = [np.cumsum(x[0]) for x in asked]
    seen, place = np.unique(np.concatenate(buckets), return_inverse=True)
    raw, good = (np.bincount(place, np.concatenate([x[c] for x in asked]), len(seen)).astype(np.int64)[place] for c in (1, 2))
    at, data = np.cumsum([0, *map(len, buckets)]), []
    for x, s, e in zip(asked, at[:-1], at[1:], strict=True):
        other = np.flatnonzero(raw[s:e] != x[1])
        data.append(packed(np.diff(other, prepend=0), raw[s:e][other], good[s:e][other]))
    return pd.DataFrame({"dest": -1 - b.batch, "batch": b.dest, "data": data})


def _score(buckets: int, slices: int):
    def run(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return pd.DataFrame({c: [] for c in (*COLUMNS, "trusted", "mean")})
        out, texts = pickle.loads(zstandard.ZstdDecompressor().decompress(own["data"].iloc[0]))
        seen, place, text = _grams(texts, buckets)
        raw = np.bincount(place, minlength=len(seen))
        good = np.bincount(place[out.trusted.to_numpy()[text]], minlength=len(seen))
        begin = np.searchsorted(seen, np.arange(slices) * (buckets // slices))
        for k, data in zip(answers["batch"], answers["data"], strict=True):
            other, raws, goods = unpacked(data, 3)
            at = begin[k] + np.cumsum(other)
            raw[at], good[at] = raws, goods
        total, n = np.bincount(text, (np.log1p(good) - np.log1p(raw))[place], len(out)), np.bincount(text, minlength=len(out))
        return out.assign(mean=total / np.maximum(n, 1))

    return run


def scores(docs: DataFrame, trusted: DataFrame, buckets: int | None = None, size: int = BATCH_BYTES, slices: int | None = None) -> DataFrame:
    """Counts and score of each row, one added to each bucket's counts; with no trusted words all scores are zero."""
    ws = Workspace(docs.sparkSession, "quality")
    plain = documents(docs)
    n_bytes = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets or bucket_count(n_bytes)
    # places within a slice are 32-bit numbers
    slices = max(slices or slice_count(n_bytes, buckets), buckets >> 31)
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).dropna().distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = plain.join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    # one exchange by dest serves the slices and the batches; both read all rows, so that Spark shares it
    sent = map_frames(marked, _scan(buckets, slices, size), MESSAGE).repartition("dest")
    answers = sent.groupBy("dest").applyInPandas(_answer, MESSAGE)
    scored = ws.keep(sent.groupBy("dest").cogroup(answers.groupBy("dest")).applyInPandas(_score(buckets, slices), SCORED), "scores")
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    all_, good = scored.agg(F.coalesce(F.sum(grams), F.lit(0)), F.coalesce(F.sum(F.when(F.col("trusted"), grams)), F.lit(0))).first()
    score = F.when(F.col("n_words") > 0, F.col("mean") + float(np.log(all_ + buckets) - np.log(good + buckets))).otherwise(0.0) if good else F.lit(0.0)
    return scored.select(*COLUMNS, score.alias("score"))


def verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """Counts, score and verdict of each row.

    A null text has no words and fails the base rules; a null doc_id stays null and is never
    trusted; repeated rows are counted and returned as often as they occur; a score of exactly
    ``threshold`` is kept; other columns are ignored; an empty table gives no rows.
    """
    return verdicts(scores(docs, trusted, buckets), threshold)


def fold(doc_id: Column) -> Column:
    """0 to 2: counted as trusted; 3: chooses the threshold; 4: in neither, for measuring."""
    return F.crc32(doc_id.cast("string")) % 5


#: What a range of scores tells: ``gap`` is less than zero, or zero where there is no cut.
RANGE = "first double, last double, good long, bad long, error long, gap double, cut double"


def _cut(error: int, below: float, above: float) -> tuple[int, float, float]:
    """Errors, the gap with a minus, and the cut in it: the least is the best."""
    middle = (below + above) / 2
    return int(error), below - above, middle if middle > below else above


def _cuts(n_good: int, n_bad: int):
    """Of ascending scores, the ends, the documents of each class and the best cut between two scores, by the errors of the range alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, good, bad, best = None, None, 0, 0, None
        for b in batches:
            if not len(b):
                continue
            at, goods, bads = b.score.to_numpy(), good + np.cumsum(b.good.to_numpy()), bad + np.cumsum(b.bad.to_numpy())
            if first is None:
                first = at[0]
            else:
                at, goods, bads = np.append(last, at), np.append(good, goods), np.append(bad, bads)
            last, good, bad = at[-1], int(goods[-1]), int(bads[-1])
            if len(at) > 1:
                errors, gaps = (goods * n_bad - bads * n_good)[:-1], np.diff(at)
                least = np.flatnonzero(errors == errors.min())
                k = least[np.argmax(gaps[least])]
                found = _cut(errors[k], float(at[k]), float(at[k + 1]))
                best = min(best or found, found)
        if first is not None:
            error, gap, cut = best or (0, 0.0, 0.0)
            yield pd.DataFrame([(first, last, good, bad, error, gap, cut)], columns=["first", "last", "good", "bad", "error", "gap", "cut"])

    return run


def best_threshold(rated: DataFrame) -> float:
    """The middle of the widest gap that splits the two classes with the least sum of error rates, by all rows of (score, quality)."""
    count = lambda c: F.count_if(F.col("quality") == c)
    at = rated.groupBy("score").agg(count(1).alias("good"), count(0).alias("bad")).where("good + bad > 0")
    n_good, n_bad = at.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("good", "bad"))).first()
    if not n_good or not n_bad:
        return THRESHOLD
    ranges = sorted(map_frames(at.repartitionByRange("score").sortWithinPartitions("score"), _cuts(n_good, n_bad), RANGE).collect())
    # errors are in whole numbers: good documents below a cut times n_bad, less bad ones below it times n_good
    best, error = (0, 0.0, ranges[0].first), 0
    for k, r in enumerate(ranges):
        if r.gap:
            best = min(best, (error + r.error, r.gap, r.cut))
        error += r.good * n_bad - r.bad * n_good
        if k + 1 < len(ranges):
            best = min(best, _cut(error, r.last, ranges[k + 1].first))
    return best[2]


def labelled_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality_rules`` with trusted documents and threshold from disjoint folds of ``labels``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["doc_id"])
    scored = scores(docs, known.where((F.col("quality") == 1) & (fold(F.col("doc_id")) < 3)))
    tuning = known.where(fold(F.col("doc_id")) == 3)
    passed = scored.where(~F.col("base_failed")).groupBy("doc_id").agg(F.min("score").alias("score")).join(tuning, "doc_id")
    return verdicts(scored, best_threshold(passed))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
