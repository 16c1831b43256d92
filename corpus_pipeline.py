"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; an empty
table passes all stages, and other columns, of any name, pass all but the last.  None of
the stages before tokens can be said in SQL (a trained model, fingerprints of 256 bits and
bootstrapped patterns), so ``ORACLE_SQL`` is None and the stages are tested one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm.bpe import bpe_codes
from sparktide.llm.common import Workspace, free_name, table
from sparktide.llm.decontamination import contaminated
from sparktide.llm.pii import redact
from sparktide.llm.simhash_dedup import near_dedup
from sparktide.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model fitted on this stage's labelled documents doesn't reject.

    Null and empty texts stay, rows stay as often as they occur; without labels of both classes all do.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id.

    Texts without words, nulls included, are one group; one row of repeated ones stays; rows
    without a doc_id give way to any row of their group that has one.
    """
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all rows of a doc_id go if one does; null texts stay."""
    leak = free_name(docs, "leak")
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, docs.doc_id.cast("long").eqNullSafe(F.col(leak)), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; null texts stay null."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and the ids (little-endian 32-bit integers, joined); none for a null text."""
    return bpe_codes(docs, decoded=False).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.keep(docs, f"stage{k}")
            if k:
                ws.drop(f"stage{k - 1}")
    return docs
