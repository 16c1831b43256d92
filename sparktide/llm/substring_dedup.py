"""Operator 2: words covered by a 20-word window that also starts earlier.

A log-structured index of fingerprints: each batch of documents (in order of doc_id) becomes
a run, an immutable table sorted by anchor with one entry - the earliest - for each (anchor,
digest) of window blocks (``anchors``).  A new batch is merge-joined with every run.  A block
that a run or an earlier row has is repeated as a whole.  Where an anchor has other contents,
the windows of those blocks are hashed from the texts themselves with 128 bits and resolved
one by one.  When there are more than ``max_runs`` runs, they are compacted into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import Workspace, documents, map_frames, row_key, spread, table, word_hashes
from .suffix_dedup import BLOCK, removed

WIDTH = 20
GRAM = 6
BATCHES = 2
MAX_RUNS = 4
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LOWEST = -(2**63)


def earliest(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each block occurs in the batch, at its earliest occurrence; 0 at the others."""
    if not len(anchor):
        return np.zeros(0, np.int32)
    order = np.lexsort((first, doc, digest, anchor))
    a, d = anchor[order], digest[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    out = np.zeros(len(anchor), np.int32)
    out[order[head]] = np.append(head[1:], len(a)) - head
    return out


def _blocks(width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, lengths = word_hashes([t.encode() for t in b.text])
            q, a, d, f, c = anchors.blocks(hashes, lengths, None, width, gram)
            doc = b.doc_id.to_numpy()[q]
            yield pd.DataFrame({"doc_id": doc, "kk": b.kk.to_numpy()[q], "anchor": a, "digest": d, "first": f.astype(np.int32), "starts": c.astype(np.int32), "copies": earliest(a, d, doc, f)})

    return run


def _windows(width: int):
    """128-bit hashes of the windows of given blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, lengths = word_hashes([t.encode() for t in b.text])
            ends, parts = np.cumsum(lengths), []
            for k, (lo, hi) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                first, count = np.asarray(b["first"].iloc[k], np.int64), np.asarray(b.starts.iloc[k], np.int64)
                at = np.repeat(first, count) + spread(count)
                with np.errstate(over="ignore"):
                    values = hashes[lo:hi]
                    h1 = anchors.mix(anchors.Prefix(values, 0).of(at, at + width))
                    h2 = anchors.mix(anchors.Prefix(anchors.mix(values), 1).of(at, at + width))
                parts.append(pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "doc_id": b.doc_id.iloc[k], "kk": b.kk.iloc[k], "at": at.astype(np.int32), "fresh": b.fresh.iloc[k]}))
            if parts:
                yield pd.concat(parts)

    return run


class SubstringIndex:
    """First occurrences of all window blocks of the documents added so far."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, max_runs: int = MAX_RUNS):
        self.ws, self.width, self.gram, self.max_runs = Workspace(spark, "substrings"), width, gram, max_runs
        self.runs: list[str] = []
        self.added = 0

    def history(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, map(self.ws.read, self.runs)) if self.runs else None

    def _write_run(self, rows: DataFrame, name: str) -> None:
        self.ws.keep(rows.repartition("anchor").sortWithinPartitions("anchor", "digest"), name)

    def compact(self) -> None:
        """Merge all runs into one; entries of different runs never share a key."""
        old, name = self.runs, f"run{self.added}c"
        self._write_run(self.history(), name)
        self.runs = [name]
        self.ws.drop(*old)

    def add(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """Hits of a batch: (doc_id, kk, at, run) window starts that occurred earlier.

        ``batch`` and ``store`` have doc_id, kk, text; ``store`` has the documents added
        before.  doc_ids of a batch are not below those added before.
        """
        ws, n, key = self.ws, self.added, ["anchor", "digest"]
        self.added += 1
        blocks = ws.keep(map_frames(batch, _blocks(self.width, self.gram), BLOCK), f"blocks{n}")
        # copies within a batch are one row by now, so they need no other sum before the exchange
        firsts = blocks.where("copies > 0").repartition("anchor").groupBy(*key).agg(F.min(F.struct("doc_id", "first", "kk", "starts")).alias("own"), F.sum("copies").alias("copies"))
        history = self.history()
        if history is None:
            known = firsts.withColumn("old", F.lit(False))
        else:
            for k, name in enumerate(self.runs):
                run = ws.read(name).select(*key, F.struct("doc_id", "first", "kk", "starts").alias(f"own{k}"))
                firsts = firsts.join(run.hint("merge"), key, "left")
            olds = [F.col(f"own{k}") for k in range(len(self.runs))]
            known = firsts.select(*key, "copies", F.coalesce(*olds, "own").alias("own"), F.coalesce(*olds).isNotNull().alias("old"))
        known = ws.keep(known, f"known{n}")
        ws.drop()
        fresh = known.where("not old").select("anchor", "digest", "own.*")
        # anchors with a new block and other contents, new or old
        counts = fresh.groupBy("anchor").agg(F.count("*").alias("contents"))
        detail = fresh.join(counts, "anchor")
        sides = [(batch, detail.where("contents > 1"), True)]
        if history is not None:
            related = ws.keep(history.join(counts, "anchor", "left_semi"), f"related{n}")
            meets = related.groupBy("anchor").agg(F.count("*").alias("met"))
            sides = [(batch, detail.join(meets, "anchor", "left").where("contents > 1 or met > 0"), True), (store, related, False)]
        windows = []
        for docs, rows, new in sides:
            own = rows.groupBy("doc_id", "kk").agg(F.collect_list(F.struct("first", "starts")).alias("x"))
            texts = docs.join(own.hint("shuffle_merge"), ["doc_id", "kk"]).select("doc_id", "kk", "text", "x.first", "x.starts", F.lit(new).alias("fresh"))
            windows.append(map_frames(texts, _windows(self.width), "h1 long, h2 long, doc_id long, kk long, at int, fresh boolean"))
        windows = ws.keep(reduce(DataFrame.unionByName, windows), f"windows{n}")
        ws.drop()
        owners = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("o"), F.count("*").alias("c")).where("c > 1").drop("c")
        single = windows.where("fresh").join(owners, ["h1", "h2"]).where(F.struct("doc_id", "at") > F.col("o")).select("doc_id", "kk", "at", F.lit(1).alias("run"))
        whole = known.where("old or copies > 1").select(*key, F.struct("own.doc_id", "own.first").alias("o"))
        copies = blocks.join(whole, key).where(F.struct("doc_id", "first") > F.col("o")).select("doc_id", "kk", F.col("first").alias("at"), F.col("starts").alias("run"))
        hits = ws.keep(copies.unionByName(single), f"hits{n}")
        self._write_run(fresh, f"run{n}")
        self.runs.append(f"run{n}")
        ws.drop(f"blocks{n}", f"known{n}", f"windows{n}", *([f"related{n}"] if history is not None else []))
        if len(self.runs) > self.max_runs:
            self.compact()
        return hits


def _finish(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, (doc, text) in enumerate(zip(b.doc_id, b.text, strict=True)):
                # bytes are cut at the contract's six white-space characters
                words = text.encode().split()
                s, e = removed(b, k, len(words), width)
                kept = [w for lo, hi in zip(np.concatenate([[0], e]), np.concatenate([s, [len(words)]]), strict=True) for w in words[lo:hi]]
                rows.append((None if doc == LOWEST else doc, len(words), int((e - s).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """What remains of each document when windows that start earlier are removed.

    One row per row of ``docs``.  A null text has no words; a null doc_id comes before all
    others; rows of one doc_id and text are one document, and rows of one doc_id with other
    texts are told apart by their starts alone; fewer than ``width`` words are kept whole;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # no doc_id can be lower than the stand-in for null; a table that has it is read as null
    keyed = documents(docs).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "text").withColumn("kk", row_key(F.col("text")))
    cuts = keyed.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)
    edges = sorted({int(x) for x in cuts})
    index = SubstringIndex(spark, width, gram, max_runs)
    hits, low = [], None
    for high in [*edges, None]:
        part = keyed if low is None else keyed.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        hits.append(index.add(part, keyed if low is None else keyed.where(F.col("doc_id") <= low)))
        low = high
    per = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "kk").agg(F.collect_set(F.struct("at", "run")).alias("x"))
    per = per.select("doc_id", "kk", F.col("x.at").alias("at"), F.col("x.run").alias("run"))
    both = keyed.join(per, ["doc_id", "kk"], "left").select("doc_id", "text", "at", "run")
    return map_frames(both, _finish(width), RESULT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
