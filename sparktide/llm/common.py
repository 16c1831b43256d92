"""Shared pieces: reading whole tables, intermediate tables in the shared folder, word ids."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LOCAL_CHECKPOINTS = "/tmp/sparktide-checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this machine only where all tasks run in the driver."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
        folder = context.getCheckpointDir()
    return folder


class Workspace:
    """A folder of intermediate tables in the shared storage.

    Written tables cut lineage: a lost executor makes Spark read them again, not rebuild them.
    ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        release_shuffles(self.spark)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; it does so when plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` with whole numbers: integers beside nulls don't pass through floats."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nulls = any(c.null_count and pa.types.is_integer(c.type) for c in b.columns)
            yield b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get if nulls else None)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(go, struct)


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; with doc_id it names a document inside an operator."""
    return F.xxhash64(F.lit(7), text)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and whole text; a null text is empty.  Other columns are left out by name."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), F.coalesce(df["text"], F.lit("")).alias("text"))


def keyed(df: DataFrame) -> DataFrame:
    """``documents`` with ``kk``, which tells rows of one doc_id apart."""
    return documents(df).withColumn("kk", row_key(F.col("text")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Ids(dict):
    """Word to id, in order of first sight."""

    def __init__(self):
        super().__init__()
        self._next = count()

    def __missing__(self, key):
        self[key] = got = next(self._next)
        return got


def word_ids(texts: Iterable[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of a batch, and each text's words as ids into them."""
    ids, out = Ids(), []
    get = ids.__getitem__
    for text in texts:
        # bytes are cut at the contracts' six white-space characters
        found = text.split()
        out.append(np.fromiter(map(get, found), np.int64, len(found)))
    return list(ids), out


def _byte_places() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 64, (1 << 6) << 8, np.uint64)


#: A random number for each byte at each of the first 64 places of a word.
_PLACES = _byte_places()
_PLACE, _BYTE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, joined, and how many words each text has.

    A word's hash is the sum of a random number for each of its bytes and their places, so
    words are neither cut out nor compared one by one.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    parts, starts_of = [], []
    lo = 0
    while lo < len(joined):
        hi = min(len(joined), lo + _CHUNK)
        # a chunk ends behind a space; a word longer than a chunk makes a longer one
        while hi < len(joined) and not is_space(joined[hi - 1 : hi])[0]:
            back = np.flatnonzero(is_space(joined[lo:hi]))
            hi = lo + int(back[-1]) + 1 if len(back) else min(len(joined), hi + _CHUNK)
        part = joined[lo:hi]
        space = is_space(part)
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(first):
            at = np.arange(first[0], len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
            tail = part[first[0] :]
            parts.append(hash_words(tail, at, first - first[0], space[first[0] :]))
            starts_of.append(first + lo)
        lo = hi
    hashes, starts = (np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.int64), *starts_of]))
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))) if len(sizes) else sizes


def hash_words(data: np.ndarray, at: np.ndarray, begin: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """Hashes of words that begin at ``begin``; ``at`` is each byte's place in its word, ``skip`` bytes don't count."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    value = _PLACES[np.minimum(at, 63) << 8 | data]
    far = np.flatnonzero(at >= 64)
    if len(far):
        with np.errstate(over="ignore"):
            value[far] = _mixed(at[far].astype(np.uint64) * _PLACE + data[far] * _BYTE)
    if skip is not None:
        value[skip] = 0
    return _mixed(np.add.reduceat(value, begin))


def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b - np.uint8(9)) < 5)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _PLACE
        x = (x ^ (x >> np.uint64(29))) * _BYTE
    return x ^ (x >> np.uint64(32))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals joined, in order."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[new], e[np.append(new[1:], len(s)) - 1]
