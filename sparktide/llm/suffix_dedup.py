"""Operator 1: bytes covered by a 200-byte string that also starts elsewhere.

1.  Each document is cut into blocks of window starts under minimizer anchors (``anchors``),
    so two equal 200-byte strings always lie under one anchor hash.
2.  Blocks are counted by (anchor, digest), first within batches.  A block that occurs twice is repeated as a whole;
    a block whose anchor has other contents too goes, once, to the shard of its anchor.
3.  Each shard is sorted by external induced sorting (``induced_sort``); the common-prefix
    values say which starts are repeated.
4.  The starts come back to all documents that hold the block, and the bytes are removed.

Nothing but (anchor, digest) keys is shuffled for all text; bytes move only for blocks whose
anchor has several contents.  Copies of a block meet as counts, so a passage that a third of
the corpus holds costs one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import Workspace, keyed, map_frames, merged, table
from .induced_sort import Growing, Shard, Store

WIDTH = 200
GRAM = 96
#: What a sorter spends on memory; beyond it, arrays are mapped files in the task's own temp folder.
SORT_MEMORY = 128 << 20
#: Bytes of a shard, and the number of shards from which shards grow instead.
SHARD_BYTES, SHARDS = 2 << 20, 10_000

_BYTE_HASHES = anchors.mix(np.arange(1, 257, dtype=np.uint64))
BLOCK = "doc_id long, kk long, anchor long, digest long, first int, starts int, copies int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blocks(width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b.text]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            q, a, d, f, c = anchors.blocks(np.frombuffer(b"".join(texts), np.uint8), lengths, _BYTE_HASHES, width, gram)
            yield pd.DataFrame({"doc_id": b.doc_id.to_numpy()[q], "kk": b.kk.to_numpy()[q], "anchor": a, "digest": d, "first": f.astype(np.int32), "starts": c.astype(np.int32), "copies": copies(a, d)})

    return run


def copies(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """How often each block occurs in the batch, at its first row; 0 at the others."""
    if not len(anchor):
        return np.zeros(0, np.int32)
    order = np.lexsort((digest, anchor))
    a, d = anchor[order], digest[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    out = np.zeros(len(anchor), np.int32)
    out[order[head]] = np.append(head[1:], len(a)) - head
    return out


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, digest, pieces = [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True):
                raw = text.encode()
                for x in own:
                    anchor.append(x["anchor"])
                    digest.append(x["digest"])
                    pieces.append(raw[x["first"] : x["first"] + x["starts"] + width - 1])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(pieces, pa.binary())], ["anchor", "digest", "piece"])

    return run


def _sort(width: int, memory: int):
    """All blocks of an anchor are in one partition, which is one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(None, memory)
        shard, anchor, digest = Shard(width, store), Growing(store, np.int64), Growing(store, np.int64)
        for b in batches:
            anchor.append(b.column("anchor").to_numpy())
            digest.append(b.column("digest").to_numpy())
            for piece in b.column("piece"):
                shard.add(piece.as_py())
        if not anchor.size:
            return
        anchor, digest = anchor.done(), digest.done()
        for own, first, run in shard.repeated():
            yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(digest[own]), pa.array(first.astype(np.int32)), pa.array(run.astype(np.int32))], ["anchor", "digest", "skip", "run"])

    return run


def removed(b: pd.DataFrame, k: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Removed intervals of one document of n symbols, from the window starts that were hit."""
    at, run = b["at"].iloc[k], b["run"].iloc[k]
    if at is None or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.asarray(at, np.int64)
    return merged(s, s + np.asarray(run, np.int64) + width - 1)


def _finish(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, (doc, text) in enumerate(zip(b.doc_id, b.text, strict=True)):
                raw = text.encode()
                s, e = removed(b, k, len(raw), width)
                kept = hashlib.sha256()
                for lo, hi in zip(np.concatenate([[0], e]), np.concatenate([s, [len(raw)]]), strict=True):
                    kept.update(raw[lo:hi])
                rows.append((doc, len(raw), int((e - s).sum()), len(s), kept.hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, memory: int = SORT_MEMORY) -> DataFrame:
    """Hit window starts per document: (doc_id, kk, at array, run array), for documents that have any.

    ``width`` is below 255.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    cuts = keyed(docs).where(F.octet_length("text") >= width)
    blocks = ws.keep(map_frames(cuts, _blocks(width, gram), BLOCK), "blocks")
    # copies within a batch are one row by now; one exchange by anchor serves both counts and the join
    dealt = blocks.where("copies > 0").repartition("anchor")
    groups = dealt.groupBy("anchor", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "kk", "first", "starts")).alias("rep"))
    contents = groups.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("copies").alias("all")).where("all > 1").drop("all")
    live = ws.keep(groups.join(contents, "anchor"), "live")
    size = live.where("contents > 1").agg(F.coalesce(F.sum(F.col("rep.starts") + width), F.lit(0))).first()[0]
    shards = min(SHARDS, 1 + size // SHARD_BYTES)
    wanted = live.where("contents > 1").select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.kk").alias("kk"), F.struct("rep.first", "rep.starts", "anchor", "digest").alias("x"))
    wanted = wanted.groupBy("doc_id", "kk").agg(F.collect_list("x").alias("own"))
    # rows that repeat an id and a text hold the same block; one of them will do
    texts = cuts.join(wanted.hint("shuffle_merge"), (cuts.doc_id.eqNullSafe(wanted.doc_id)) & (cuts.kk == wanted.kk)).select("text", "own")
    pieces = texts.mapInArrow(_cut(width), "anchor long, digest long, piece binary")
    found = pieces.repartition(shards, "anchor").mapInArrow(_sort(width, memory), "anchor long, digest long, skip int, run int")
    whole = live.where("copies > 1").select("anchor", "digest", F.lit(0).alias("skip"), F.col("rep.starts").alias("run"))
    single = live.where("copies = 1 and contents > 1").select("anchor", "digest")
    hits = ws.keep(whole.unionByName(found.distinct().join(single, ["anchor", "digest"], "left_semi")), "hits")
    ws.drop("live")
    spots = blocks.join(hits, ["anchor", "digest"]).select("doc_id", "kk", F.struct((F.col("first") + F.col("skip")).alias("at"), "run").alias("x"))
    # a repeated row has the same hits; sets keep one of each
    per = spots.groupBy("doc_id", "kk").agg(F.collect_set("x").alias("x"))
    return per.select("doc_id", "kk", F.col("x.at").alias("at"), F.col("x.run").alias("run"))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, memory: int = SORT_MEMORY) -> DataFrame:
    """What remains of each document when repeated ``width``-byte strings are removed.

    One row per row of ``docs``.  A null text is empty; a null doc_id is kept as such; texts
    shorter than ``width`` keep all bytes; a repeated row is a copy like any other, so both
    lose their repeated bytes; other columns are ignored; an empty table gives no rows.
    """
    hits = repeated_bytes(docs, width, gram, memory)
    every = keyed(docs)
    both = every.join(hits, every.doc_id.eqNullSafe(hits.doc_id) & (every.kk == hits.kk), "left").select(every.doc_id, "text", "at", "run")
    return map_frames(both, _finish(width), RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
