"""Operator 6: toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 <= t_1 <= ...;
the expected severity is the sum of these probabilities.  Features are words and beginnings of
words, of a bounded vocabulary, as 1 + log(count); a word is a feature if the labels tell with
significance that it marks toxic documents.  The labels say only whether a document is toxic;
its training grade above 0 is the third that it belongs to when the toxic documents are ordered
by how many marking words they have.  Weights are not negative: no word makes a text less toxic.

Training weighs both classes alike; afterwards the thresholds are moved to the share of toxic
labels, so that probabilities are those of the corpus.  A document is toxic if its evidence
w.x reaches a cut that is chosen on the training rows, each scored by a model that has not
seen it.  The cut is above zero: a document without evidence is never toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_frames, table

TOKENS = re.compile(r"[^\W\d_]+")
#: Most labelled rows of each class that training sees, chosen by a hash of doc_id.
SAMPLE = 2000
#: Words whose features a task remembers before it starts anew.
MEMORY = 200_000
VOCABULARY = 512
BEGINNINGS = (4, 5)
#: Least log odds of a feature; words of clean text would only teach how long documents are.
EVIDENCE = 1.5
#: Least log-likelihood ratio statistic of a feature: by chance one word in 100,000 has it, whatever the number of labels.
SIGNIFICANT = 20.0
#: Grades of toxic documents.
LEVELS = 3
#: Least log odds of a word that counts towards the grade.
MARKING = 2.0
STEPS, RATE, PENALTY = 800, 0.05, 2e-4
#: The cut of models that can't choose one: evidence that multiplies the odds by 20.
CUT = 3.0
#: A false alarm weighs as much as so many missed documents when the cut is chosen, by rates.
CLEAN_WEIGHT = 4.0
RESULT = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def counts(text: str) -> Counter:
    """Words and beginnings of words ("abcd*"), which inflected languages need."""
    bag = Counter(TOKENS.findall(text.lower()))
    for w, n in list(bag.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                bag[w[:k] + "*"] += n
    return bag


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    """Words, their weights, thresholds in ascending order, and the least evidence of a toxic document."""

    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray, cut: float = CUT):
        self.index, self.weights, self.thresholds, self.cut = {w: k for k, w in enumerate(words)}, weights, thresholds, cut
        self.known: dict[str, list[int]] = {}

    def evidence(self, text: str) -> float:
        if len(self.known) > MEMORY:
            self.known = {}
        known, found = self.known, Counter()
        for w in TOKENS.findall(text.lower()):
            features = known.get(w)
            if features is None:
                features = known[w] = [k for f in counts(w) if (k := self.index.get(f)) is not None]
            if features:
                found.update(features)
        return float(sum(self.weights[k] * (1 + np.log(n)) for k, n in sorted(found.items())))

    def above(self, evidence: float) -> np.ndarray:
        """P(grade > k) for each k."""
        return sigmoid(evidence - self.thresholds)

    def is_toxic(self, text: str) -> bool:
        return self.evidence(text) >= self.cut


def markers(bags: list[Counter], toxic: np.ndarray) -> dict[str, float]:
    """Log odds of toxic against other documents, for the words whose odds can't be chance."""
    yes, no = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (yes if t else no).update(bag.keys())
    n_yes, n_no = int(toxic.sum()), int((~toxic).sum())
    words = sorted(yes)
    a, b = np.array([yes[w] for w in words], float), np.array([no[w] for w in words], float)
    odds = np.log((a + 0.5) / (n_yes + 1)) - np.log((b + 0.5) / (n_no + 1))
    total, statistic = n_yes + n_no, np.zeros(len(words))
    for have, all_ in ((a, n_yes), (b, n_no)):
        for got, expected in ((have, (a + b) * all_ / total), (all_ - have, (total - a - b) * all_ / total)):
            statistic += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1) / np.maximum(expected, 1e-12)), 0)
    take = np.flatnonzero((odds >= EVIDENCE) & (statistic >= SIGNIFICANT))
    return {words[k]: float(odds[k]) for k in take}


def best_cut(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut above zero that misses and accuses least; of equal ones the middle of the widest gap."""
    if not len(toxic) or not len(clean) or toxic.max() <= 0:
        return CUT
    at = np.unique(np.concatenate([[0.0], toxic, clean]))
    at = at[at >= 0]
    cuts = (at[1:] + at[:-1]) / 2
    cost = np.searchsorted(np.sort(toxic), cuts) / len(toxic) + CLEAN_WEIGHT * (1 - np.searchsorted(np.sort(clean), cuts) / len(clean))
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(cuts[best[np.argmax(np.diff(at)[best])]])


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Ordinal:
    """A model of all rows, with the cut that suits two models of a half each on the other half.

    ``share`` is that of toxic documents, if the rows are not a fair sample.
    """
    # a text that was copied many times is one piece of evidence
    texts, labels = zip(*sorted({(t, y) for t, y in zip(texts, labels, strict=True)}), strict=True)
    toxic = np.array(labels) > 0
    bags = [counts(t) for t in texts]
    half = np.array([zlib.crc32(t.encode()) % 2 for t in texts], bool)
    found: list[tuple[float, bool]] = []
    for part in (half, ~half):
        if toxic[part].any() and not toxic[part].all():
            model = _fit([x for x, p in zip(bags, part, strict=True) if p], toxic[part], 0.5)
            found += [(model.evidence(t), y) for t, y, p in zip(texts, toxic.tolist(), part, strict=True) if not p]
    model = _fit(bags, toxic, toxic.mean() if share is None else share)
    model.cut = best_cut(np.array([z for z, y in found if y]), np.array([z for z, y in found if not y]))
    return model


def _fit(bags: list[Counter], toxic: np.ndarray, share: float) -> Ordinal:
    """Proportional odds by Adam on the mean log likelihood with an L2 penalty."""
    odds = markers(bags, toxic)
    # the strongest evidence first: odds weighed by how many documents have the word
    seen = Counter(w for bag in bags for w in bag if w in odds)
    words = sorted(odds, key=lambda w: (-odds[w] * np.sqrt(seen[w]), w))[:VOCABULARY]
    marking = {w for w in words if odds[w] >= MARKING and not w.endswith("*")}
    marks = np.array([sum(n for w, n in bag.items() if w in marking) for bag in bags])
    edges = np.quantile(marks[toxic], np.arange(1, LEVELS) / LEVELS)
    grades = np.where(toxic, 1 + (marks[:, None] > edges).sum(axis=1), 0)
    index = {w: k for k, w in enumerate(words)}
    row = np.concatenate([np.full(sum(w in index for w in bag), i) for i, bag in enumerate(bags)]).astype(np.int64)
    col = np.array([index[w] for bag in bags for w in bag if w in index], np.int64)
    val = np.array([1 + np.log(n) for bag in bags for w, n in bag.items() if w in index])
    levels = LEVELS
    weights, base, gaps = np.zeros(len(words)), 1.0, np.zeros(levels - 1)
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    params = [weights, np.array([base]), gaps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    place = np.arange(len(bags))
    for step in range(1, STEPS + 1):
        w, b, g = params
        thresholds = b[0] + np.concatenate([[0], np.cumsum(np.exp(g))])
        z = np.bincount(row, val * w[col], len(bags))
        p = sigmoid(z[:, None] - thresholds)
        bounds = np.concatenate([np.ones((len(z), 1)), p, np.zeros((len(z), 1))], axis=1)
        upper, lower = bounds[place, grades], bounds[place, grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        slope_up, slope_low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        dz = -weight * (slope_up - slope_low)
        dt = np.zeros((len(z), levels + 2))
        dt[place, grades] += weight * slope_up
        dt[place, grades + 1] -= weight * slope_low
        dt = dt[:, 1:-1].sum(axis=0)
        grads = [np.bincount(col, val * dz[row], len(words)) + PENALTY * w, np.array([dt.sum()]), np.exp(g) * (dt[::-1].cumsum()[::-1][1:])]
        for q, m, v, d in zip(params, first, second, grads, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(params[0], 0, out=params[0])
    # both classes weighed a half: the odds are those of the corpus after this shift
    prior = np.log((1 - share) / share)
    return Ordinal(words, params[0], prior + params[1][0] + np.concatenate([[0], np.cumsum(np.exp(params[2]))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().dropDuplicates(["doc_id"])
    picks = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = documents(docs).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r.toxic for r in rows}) < 2:
        return Ordinal([], np.zeros(0), np.full(LEVELS, 40.0))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    return fit([r.text for r in rows], [r.toxic for r in rows], min(max(share, 1e-6), 1 - 1e-6))


def _grade(model: Ordinal):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            evidence = np.array([model.evidence(t) for t in b.text], float)
            above = np.array([model.above(z) for z in evidence]).reshape(len(b), -1)
            yield pd.DataFrame({"doc_id": b.doc_id, "severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype(np.int32), "p_toxic": above[:, 0], "toxic": evidence >= model.cut})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Expected severity, most likely grade and verdict of each row.

    A null or empty text has no words: its severity is that of the thresholds alone and it is
    never toxic; a null doc_id stays null and is never a label; of rows that share a doc_id one
    is learnt from; evidence equal to the cut is toxic; rows are returned as often as they
    occur; whole texts are read, however long; without labels of both classes nothing is toxic;
    other columns are ignored; an empty table gives no rows.
    """
    return map_frames(documents(docs), _grade(train(docs, labels, sample)), RESULT)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all columns; a null text is not."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not model.is_toxic(t or "") for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
