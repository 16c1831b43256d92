"""Operator 8: test items inside documents, by size-partitioned MinHash containment search.

DataFrame functions only.  Items are partitioned by their number of shingles, in classes of a
power of two.  The class decides how many shingles an item of it may miss at most, and with it
the length of the sketch: that many and ``HITS`` more of the item's smallest hashes (bottom-k
MinHash).  An item of which 0.8 or more lies in a document can miss no more than its share, so
the document holds at least ``HITS`` hashes of a full sketch; no document is lost, and chance
hits rarely make a candidate.  Long documents need no sketch and cost one pass over their
shingles.  Candidates are verified by counting the item's distinct shingles that they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Hashes of an item's sketch that a document must hold at least.
HITS = 4
#: The sketches are broadcast only when their rows, counted first, are at most this many.
BROADCAST_ROWS = 200_000
#: Beyond that, hashes are cut to so many values, which are broadcast to prune the documents' shingles before they are dealt out.
PRUNE = 1 << 22


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")


def shingle_hashes(w: Column, k: int) -> Column:
    """A 64-bit hash for each shingle, in order; fewer than k words have none."""
    steps = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(steps, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, k: int) -> Column:
    steps = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(steps, lambda i: F.array_join(F.slice(w, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) at ``containment`` or more.

    Shingles are of lower-cased letters and digits, each counted once.  Items or documents of
    fewer than ``shingle`` words, or with a null text, match nothing.  Each row is judged by
    itself; of rows of one doc_id, the null id included, the one that holds most of an item
    counts.  Repeated items count once for each item_id, the best text of an id; other columns
    are ignored; an empty table, of documents or of items, gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    w = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    sets = w.select("item_id", F.array_distinct(shingle_texts(F.col("w"), shingle)).alias("sh")).where("size(sh) > 0").distinct()
    sized = sets.select("item_id", "sh", F.size("sh").alias("n_item"), F.floor(F.log2(F.size("sh"))).cast("int").alias("size_class"))
    sized = sized.withColumn("need", F.ceil(F.round(F.col("n_item") * containment, 6)).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    # what items of the class may miss at most, and so the sketch; what a full sketch leaves of it
    length = F.least(F.col("n_item"), F.floor(F.round(largest * (1 - containment), 6)).cast("int") + HITS)
    sized = ws.keep(sized.withColumn("length", length).withColumn("hits", F.greatest(F.lit(1), length - (F.col("n_item") - F.col("need")))), "items")
    hashed = F.transform("sh", lambda s: F.struct(F.xxhash64(*[F.get(F.split(s, " "), F.lit(j)) for j in range(shingle)]).alias("h"), s.alias("s")))
    sketch = sized.select("item_id", "sh", F.slice(F.array_sort(F.transform(hashed, lambda x: x["h"])), F.lit(1), F.col("length")).alias("low"), "hits")
    members = ws.keep(sketch.select("item_id", F.xxhash64("sh").alias("set"), "hits", F.explode("low").alias("h")), "sketch")
    wanted = members.select("h").distinct()
    # a fifth or more of all shingles of the items are in the sketches, so their count bounds all that is broadcast;
    # PRUNE bounds what is broadcast beyond
    few = members.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words(F.col("text")))).alias("w"))
    seen = texts.select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("w"), shingle))).alias("h"))
    if not few:
        rough = wanted.select(F.pmod("h", F.lit(PRUNE)).alias("rough")).distinct()
        seen = seen.join(F.broadcast(rough), F.pmod("h", F.lit(PRUNE)) == F.col("rough"), "left_semi")
    hits = seen.join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    # hot sketch hashes meet a few items each; (doc, item) pairs are counted before texts come in
    pairs = hits.join(F.broadcast(members) if few else members, "h").groupBy("doc_id", "item_id", "set", "hits").agg(F.count("*").alias("n")).where("n >= hits").drop("n", "hits")
    candidates = ws.keep(pairs.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "set")).alias("c")), "candidates")
    both = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(candidates, F.col("id").eqNullSafe(F.col("doc_id")))
    # words are a generated column: an expression inside the lambdas would be split again for each shingle
    cut = both.select("doc_id", "c", F.explode(F.array(words(F.col("text")))).alias("w"))
    sets = cut.select("doc_id", "c", F.explode(F.array(F.array_distinct(shingle_texts(F.col("w"), shingle)))).alias("held"))
    held = sets.select("doc_id", "held", F.explode("c").alias("c"))
    facts = sized.withColumn("set", F.xxhash64("sh")).withColumnRenamed("item_id", "item")
    checked = held.join(F.broadcast(facts) if few else facts, F.col("c.item_id").eqNullSafe(F.col("item")) & (F.col("c.set") == F.col("set")))
    shared = checked.select("doc_id", F.col("item").alias("item_id"), "n_item", "need", "size_class", F.size(F.array_intersect("sh", "held")).alias("n_shared"))
    best = shared.where("n_shared >= need").groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared", "size_class")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id)
WHERE n_shared >= ceil(round(n_item * 0.8, 6))
"""
