"""Operator 9: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of the whole document.  Their values are max-pooled in
chunks of 256 places that overlap by half, so chunks cover every byte; the mean and the maximum
over chunks are combined into one probability.  Training runs on the driver over a bounded
sample of labelled rows; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_frames, table

FILTERS, WIDTH, HALF = 16, 5, 128
#: Most labelled rows of each class that training sees, chosen by a hash of doc_id.
SAMPLE = 1500
EPOCHS, RATE = 8, 0.02
FOLDS = 5
THRESHOLD = 0.3
PIECE = 1 << 16
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Network:
    """Filters as tables: the weight of byte v at offset j is ``table[j, v]``, a row of filters."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.3).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def halves(self, x: np.ndarray, places: bool = False):
        """Maxima of the filters in each half chunk, and where they are."""
        x = np.concatenate([x, np.zeros(max(0, WIDTH - len(x)), np.uint8)])
        n = len(x) - WIDTH + 1
        best, where = [], []
        for start in range(0, n, PIECE):
            m = min(PIECE, n - start)
            act = self.table[0][x[start : start + m]]
            for j in range(1, WIDTH):
                act += self.table[j][x[start + j : start + j + m]]
            pad = -m % HALF
            if pad:
                act = np.concatenate([act, np.full((pad, FILTERS), -np.inf, np.float32)])
            act = act.reshape(-1, HALF, FILTERS)
            if places:
                at = act.argmax(axis=1)
                best.append(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0])
                where.append(at + (start + np.arange(len(at)) * HALF)[:, None])
            else:
                best.append(act.max(axis=1))
        best = np.concatenate(best)
        return (best, np.concatenate(where), x) if places else best

    @staticmethod
    def chunks(half: np.ndarray) -> np.ndarray:
        """Each chunk is two neighbouring halves; a single half is a chunk."""
        return half if len(half) == 1 else np.maximum(half[:-1], half[1:])

    def score(self, text: bytes) -> float:
        chunk = np.maximum(self.chunks(self.halves(np.frombuffer(text, np.uint8))) + self.bias, 0)
        z = float(np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]) @ self.out + self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, text: bytes, label: int, weight: float):
        half, at, x = self.halves(np.frombuffer(text, np.uint8), True)
        if len(half) == 1:
            chunk, place = half, at
        else:
            left = half[:-1] >= half[1:]
            chunk, place = np.where(left, half[:-1], half[1:]), np.where(left, at[:-1], at[1:])
        chunk = chunk + self.bias
        relu = np.maximum(chunk, 0)
        top = relu.argmax(axis=0)
        features = np.concatenate([relu.mean(axis=0), relu.max(axis=0)])
        z = float(features @ self.out + self.out_bias[0])
        error = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label))
        down = np.broadcast_to(error * self.out[:FILTERS] / len(chunk), chunk.shape).copy()
        down[top, np.arange(FILTERS)] += error * self.out[FILTERS:]
        down *= chunk > 0
        table = np.zeros_like(self.table)
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        for j in range(WIDTH):
            np.add.at(table[j], (x[place + j], f), down)
        return table, down.sum(axis=0), error * features, np.array([error], np.float32)

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, batch: int = 8, seed: int = 0) -> Network:
        """Adam over batches; classes weigh alike."""
        rng = np.random.default_rng(seed)
        y = np.array(labels)
        share = max(1, int(y.sum())), max(1, int((1 - y).sum()))
        params = [self.table, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                total = [np.zeros_like(p) for p in params]
                for i in order[k : k + batch].tolist():
                    weight = len(texts) / 2 / (share[0] if y[i] else share[1]) / batch
                    for t, g in zip(total, self.gradients(texts[i], int(y[i]), weight), strict=True):
                        t += g
                step += 1
                r = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for p, m, v, g in zip(params, first, second, total, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (r * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` rows of each class outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    picks = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    rows = documents(docs).join(chosen, "doc_id").select("doc_id", "text", "quality").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r.quality for r in rows}) < 2:
        return Network()
    return Network().fit([r.text.encode() for r in rows], [r.quality for r in rows])


def _score(network: Network):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "held_out": b.held_out, "score": [network.score(t.encode()) for t in b.text]})

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score of each row; ``predicted`` is 1 from 0.3 on.

    A null text is empty, and empty texts have the score of a few zero bytes; a null doc_id is
    not held out and never a label; of rows that share a doc_id one is learnt from; rows are
    returned as often as they occur; without labels of both classes the network is untrained;
    other columns are ignored; an empty table gives no rows.
    """
    network = train(docs, labels, sample)
    scored = map_frames(documents(docs).withColumn("held_out", held_out(F.col("doc_id"))), _score(network), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
