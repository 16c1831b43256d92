"""Operator 7: personal data, by patterns and by bootstrapped contexts.

Base patterns find e-mail and IP addresses, cards and phone numbers.  These seed a bootstrap
over the whole corpus.  A lexical pattern is what stands around a slot: the word before it, the
two words before it, or the words on both sides, A-Z in lower case, without punctuation at
their ends and with all digits alike.

1.  Patterns around at least ``SUPPORT`` different seeds are candidates.
2.  One scan counts how often each of them has anything in its slot, and how often a seed;
    patterns that seeds hardly ever fill, such as common words, go at once.
3.  One scan takes every word, of letters or digits and of any length, that stands in a slot of
    the others.  Spark scores the bipartite graph of patterns and instances in rounds until
    nothing changes: a pattern's confidence is the share of its distinct instances that are
    known, an instance becomes known when patterns of high confidence agree on it.

Occurrences of discovered instances in slots of accepted patterns are of kind ``id``.  Words are
cut at white space, ``:`` and ``=``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free_name, hash_words, is_space, keyed, map_frames, row_key, spread, table

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails from the start of a run of digits fails from inside it too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]{4,}")
NOT_DIGIT = re.compile(r"[^0-9]+")
KINDS = ("email", "ip", "card", "phone", "id")
#: Least known instances of a pattern, least share of them, and least score of an instance.
SUPPORT, CONFIDENCE, SCORE = 5, 0.8, 0.95
#: Least share of a pattern's slots that seeds fill, below which its instances are not looked at.
FLOOR = 0.1
#: Patterns that one scan of the texts looks for; more take more scans.
PATTERNS = 100_000
#: Characters of text whose words are cut together.
CHUNK = 1 << 18
EDGES = b".,;!?\"'()[]{}<>*#$%&|-"
#: Bytes as patterns have them: A-Z in lower case, all digits alike, and words cut at ``:`` and ``=`` too.
PLAIN = bytes(32 if c in b":=" else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_EDGE = np.isin(np.arange(256), np.frombuffer(EDGES, np.uint8))
TELLING = re.compile(rb"[0-9@]")
#: Discovered spans are broadcast only when there are at most so many.
BROADCAST_ROWS = 100_000
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind, then start."""
    out = emails(text)
    if DIGITS.search(text) or re.search("[0-9]", text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def cut(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, without edge characters, unless it has no others."""
    b = np.frombuffer(plain, np.uint8)
    space = is_space(b)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    start, end = first.copy(), last.copy()
    for side, step in ((start, 1), (end, -1)):
        at = np.arange(len(side))
        while len(at):
            at = at[(start[at] < end[at]) & IS_EDGE[b[np.minimum(side[at] - (step < 0), len(b) - 1)]]]
            side[at] += step
    bare = start >= end
    start[bare], end[bare] = first[bare], last[bare]
    parts = [np.zeros(0, np.uint64)]
    # a slice of words at a time: the places of bytes are wide
    for k in range(0, len(start), 1 << 15):
        sizes = end[k : k + (1 << 15)] - start[k : k + (1 << 15)]
        place = spread(sizes)
        parts.append(hash_words(b[np.repeat(start[k : k + (1 << 15)], sizes) + place], place, np.cumsum(sizes) - sizes))
    return start, end, np.concatenate(parts)


def word_hash(words: Iterable[str]) -> np.ndarray:
    """Hashes of words that are as patterns have them."""
    return np.array([cut(w.encode())[2][0] for w in words], np.uint64)


def joined_spans(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """Spans of any kind, those that overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Chunk:
    """Words of some texts, joined; places are bytes of the whole."""

    def __init__(self, texts: list[str]):
        self.texts, raws = texts, [t.encode() for t in texts]
        self.raw = b" ".join([*raws, b""])
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
        self.plain = self.raw.translate(PLAIN)
        self.start, self.end, self.hash = cut(self.plain)
        self.own = np.searchsorted(self.begin, self.start, side="right") - 1
        self._spans: dict[int, list[tuple[int, int]]] = {}

    def norm(self, i: int) -> str:
        return self.plain[self.start[i] : self.end[i]].decode()

    def spans(self, text: int, base: list[Span] | None = None) -> list[tuple[int, int]]:
        """Base spans of a text."""
        if text not in self._spans:
            t, at, done, out = self.texts[text], int(self.begin[text]), 0, []
            for s, e in joined_spans(base_spans(t) if base is None else base):
                a = at + len(t[done:s].encode())
                at = a + len(t[s:e].encode())
                done = e
                out.append((a, at))
            self._spans[text] = out
        return self._spans[text]

    def chars(self, text: int, place: int) -> int:
        return len(self.raw[self.begin[text] : place].decode())

    def contexts(self, i: int, after: int) -> list[str]:
        """Patterns of the slot of words ``i`` up to ``after``."""
        own, n, out = self.own, self.norm, []
        if i and own[i - 1] == own[i]:
            left = n(i - 1)
            out.append(f"{left} _")
            if i > 1 and own[i - 2] == own[i]:
                out.append(f"{n(i - 2)} {left} _")
            if after < len(own) and own[after] == own[i]:
                out.append(f"{left} _ {n(after)}")
        return out

    def slot(self, i: int) -> tuple[int, int, bool, int]:
        """Start, end, whether a seed fills it, and the word after it, of the slot that begins with word ``i``."""
        a, b = int(self.start[i]), int(self.end[i])
        if TELLING.search(self.raw, a, b):
            spans = self.spans(int(self.own[i]))
            k = bisect_right(spans, (b - 1, len(self.raw))) - 1
            if k >= 0 and spans[k][1] > a:
                return *spans[k], True, int(np.searchsorted(self.start, spans[k][1]))
        return a, b, False, i + 1

    def seeds(self, text: int, base: list[Span]) -> Iterator[tuple[str, str]]:
        """(pattern, instance) of all base spans of a text."""
        for s, e in self.spans(text, base):
            i = int(np.searchsorted(self.end, s, side="right"))
            instance = self.raw[s:e].decode()
            for c in self.contexts(i, int(np.searchsorted(self.start, e))):
                yield c, instance

    def slots(self, patterns: set[str], left: np.ndarray) -> Iterator[tuple[int, tuple[int, int, bool, int], list[str]]]:
        """Slots of given patterns, the words before which have the hashes ``left``."""
        hits = np.flatnonzero(np.isin(self.hash[:-1], left) & (self.own[1:] == self.own[:-1])) + 1
        for i in hits.tolist():
            slot = self.slot(i)
            met = [c for c in self.contexts(i, slot[3]) if c in patterns]
            if met:
                yield i, slot, met


def chunks(texts: Iterable[str]) -> Iterator[tuple[int, Chunk]]:
    """Chunks of texts in order, with the place of their first one."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, Chunk(held)
            held, size, first = [], 0, k + 1
    if held:
        yield first, Chunk(held)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCAN = "doc_id long, kk long, n_email long, n_ip long, n_card long, n_phone long, base string, seeds array<struct<context:string,instance:string>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, kk, text in zip(b.doc_id, b.kk, b.text, strict=True):
            base = base_spans(text)
            seeds = [{"context": c, "instance": x} for c, x in Chunk([text]).seeds(0, base)] if base else []
            rows.append((doc, kk, *[sum(k == n for k, _, _ in base) for n in range(4)], joined(base), seeds))
        out = pd.DataFrame(rows, columns=["doc_id", "kk", "n_email", "n_ip", "n_card", "n_phone", "base", "seeds"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def _left(patterns: set[str]) -> np.ndarray:
    """Hashes of the words right before the slots."""
    return word_hash({c[: c.index(" _")].rsplit(" ", 1)[-1] for c in patterns})


def _count(patterns: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = _left(patterns)
        for b in batches:
            every, filled = Counter(), Counter()
            for _, chunk in chunks(b.text):
                for _, slot, met in chunk.slots(patterns, left):
                    every.update(met)
                    if slot[2]:
                        filled.update(met)
            yield pd.DataFrame({"context": list(every), "n": list(every.values()), "seeds": [filled[c] for c in every]})

    return run


def _take(patterns: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = _left(patterns)
        for b in batches:
            rows, doc, kk = [], b.doc_id.tolist(), b.kk.tolist()
            for first, chunk in chunks(b.text):
                for i, (start, end, seed, _), met in chunk.slots(patterns, left):
                    if not seed:
                        text = int(chunk.own[i])
                        a = chunk.chars(text, start)
                        instance = chunk.raw[start:end].decode()
                        rows += [(doc[first + text], kk[first + text], c, instance, a, a + len(instance)) for c in met]
            out = pd.DataFrame(rows, columns=["doc_id", "kk", "context", "instance", "start", "end"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _in_blocks(patterns: DataFrame, scan: Callable[[set[str]], DataFrame], schema: str) -> DataFrame:
    """The rows that scans for all patterns give, at most ``PATTERNS`` of them a scan."""
    spark, blocks = patterns.sparkSession, -(-patterns.count() // PATTERNS)
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("context"), F.lit(blocks)) == k).select("context").collect()
        out = out.unionByName(scan({r.context for r in part}))
    return out


def discover(ws: Workspace, graph: DataFrame) -> DataFrame:
    """(context, instance) pairs that the bootstrap accepts, of distinct pairs with their flag ``seed``.

    A frequent context meets many instances: its pairs are distinct before anything is joined,
    so a context of a third of all words is one row for each instance.
    """
    known, before, k = graph.where("seed").select("instance", F.lit(True).alias("known")).distinct(), -1, 0
    while True:
        marked = graph.join(known, "instance", "left").select("context", "instance", F.coalesce("known", F.lit(False)).alias("known"))
        scores = marked.groupBy("context").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))
        good = scores.where((F.col("n_known") >= SUPPORT) & (F.col("n_known") >= CONFIDENCE * F.col("n"))).select("context", (F.col("n_known") / (F.col("n") + 1)).alias("confidence"))
        good = ws.keep(good, f"patterns{k}")
        votes = graph.where("not seed").join(good, "context")
        # noisy-or of the contexts that have the instance
        score = votes.groupBy("instance").agg((1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("score"))
        new = ws.keep(score.where(F.col("score") >= SCORE).select("instance", F.lit(True).alias("known")), f"new{k}")
        found = new.count()
        # known instances only raise confidences, so their number tells whether anything changed
        if found == before:
            return votes.join(new, "instance", "left_semi").select("context", "instance").distinct()
        known = ws.keep(graph.where("seed").select("instance", F.lit(True).alias("known")).unionByName(new).distinct(), f"known{k}")
        before, k = found, k + 1


MORE = "doc_id long, kk long, more array<struct<start:int,end:int>>"


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scan of every row, and the discovered spans: (doc_id, kk, more array of start and end)."""
    ws = Workspace(docs.sparkSession, "pii")
    texts = keyed(docs)
    scan = ws.keep(map_frames(texts, _scan, SCAN), "scan")
    seeds = ws.keep(scan.select(F.explode("seeds").alias("x")).select("x.*").distinct(), "seeds")
    patterns = ws.keep(seeds.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("context"), "candidates")
    counts = _in_blocks(patterns, lambda p: map_frames(texts, _count(p), "context string, n long, seeds long"), "context string, n long, seeds long")
    counts = counts.groupBy("context").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
    patterns = ws.keep(counts.where(F.col("seeds") >= FLOOR * F.col("n")).select("context"), "patterns")
    if patterns.isEmpty():
        return scan, docs.sparkSession.createDataFrame([], MORE)
    taken = "doc_id long, kk long, context string, instance string, start int, end int"
    found = ws.keep(_in_blocks(patterns, lambda p: map_frames(texts, _take(p), taken), taken), "found")
    graph = seeds.join(patterns, "context", "left_semi").select("context", "instance", F.lit(True).alias("seed")).unionByName(found.select("context", "instance", F.lit(False).alias("seed")))
    pairs = discover(ws, ws.keep(graph.groupBy("context", "instance").agg(F.max("seed").alias("seed")), "graph"))
    more = found.join(pairs, ["context", "instance"], "left_semi").groupBy("doc_id", "kk").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    return scan, ws.keep(more, "more")


def pii_spans(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row; ``base`` and ``spans`` are lists of kind:start:end.

    A null text is empty; a null doc_id stays null; rows of one doc_id and text are alike and
    all returned; other columns are ignored; an empty table gives no rows.
    """
    scan, more = spans_of(docs)
    m = more.withColumnsRenamed({"doc_id": "d", "kk": "k"})
    if more.count() <= BROADCAST_ROWS:
        m = F.broadcast(m)
    both = scan.join(m, scan.doc_id.eqNullSafe(F.col("d")) & (scan.kk == F.col("k")), "left")
    extra = F.transform("more", lambda x: F.concat(F.lit("id:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), F.coalesce(extra, F.array().cast("array<string>"))), lambda s: s != ""), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def redacted(text: str, more: list[Span]) -> str:
    out, last = [], 0
    for k, s, e in sorted(base_spans(text) + more, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _redact(more: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(4, x["start"], x["end"]) for x in m or []] for m in b.column(more).to_pylist()]
            texts = [None if t is None else redacted(t, m) for t, m in zip(b.column("text").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], columns)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by [KIND]; all columns and rows stay, n_chars follows the text.

    Overlapping spans become one, named after the first; a null text stays null; rows of one
    doc_id and text are alike; other columns keep their values, whatever their names and types.
    """
    _, found = spans_of(docs)
    doc, kk, more = (free_name(docs, x) for x in ("doc", "key", "more"))
    m = found.withColumnsRenamed({"doc_id": doc, "kk": kk, "more": more})
    if found.count() <= BROADCAST_ROWS:
        m = F.broadcast(m)
    both = docs.join(m, docs.doc_id.cast("long").eqNullSafe(F.col(doc)) & (row_key(F.coalesce(docs.text, F.lit(""))) == F.col(kk)), "left").drop(doc, kk)
    out = both.mapInArrow(_redact(more, docs.columns), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
