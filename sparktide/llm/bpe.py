"""Operator 5: byte-level BPE, encoded by speculation and verification.

Texts are cut into pieces by the pattern of the vocabulary.  For each distinct piece, greedy
longest matching proposes tokens.  A sequence of tokens is the BPE encoding of its bytes if
every token encodes to itself and every two neighbours stay apart when merged on their own;
that is tested for all neighbours of all new pieces at once, by walking back the merges on
both sides of the border.  Only pieces that fail go through exact merging: the two tokens at a
failing border are merged exactly, byte by byte, and their neighbours tested again, until all
borders hold; a piece that does not settle is merged exactly as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_frames, table

#: Pieces that GPT-2-style vocabularies never merge across (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts that have no character of ``OTHER``, whose letters and digits are these.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
COMMON = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
OTHER = r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\U0010ffff]"
#: Distinct pieces, and pairs of tokens, that a task remembers before it starts anew.
MEMORY, PAIRS = 400_000, 400_000
#: Steps of a repair for each token of a piece, and a few more, before the piece is merged as a whole.
PATIENCE = 8
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        pairs = [(self.ids[raw(a)], self.ids[raw(b)]) for a, b in merges]
        self.ranks = {p: k for k, p in reversed(list(enumerate(pairs)))}
        # how each token is made: its parts, and the rank of the merge (-1: a byte)
        self.left, self.right, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for (a, b), k in self.ranks.items():
            made = self.ids[self.bytes[a] + self.bytes[b]]
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, k
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.longest = max(map(len, self.ids))
        # each beginning of a token: its id, or -1 if it is none itself
        self.prefixes = {b[:k]: -1 for b in self.ids for k in range(1, len(b) + 1)} | self.ids
        self.sound: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern, self.common, self.other = regex.compile(PATTERN), re.compile(COMMON), re.compile(OTHER)
        # what the bytes of two neighbours encode to; None if that is the two themselves
        self.settled: dict[int, list[int] | None] = {}
        self.known: dict[str, bytes] = {}
        self.failed = 0

    # exact merging

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by definition: the pair of least rank is merged, leftmost first."""
        parts = [self.ids[piece[k : k + 1]] for k in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        while len(parts) > 1:
            ranks = [self.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [self.ids[self.bytes[parts[k]] + self.bytes[parts[k + 1]]]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, so that a very long piece takes n log n steps."""
        import heapq

        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or parts[k] != a or parts[j] != b:
                continue
            parts[k] = self.ids[self.bytes[a] + self.bytes[b]]
            alive[j], after[k] = False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    # speculation

    def propose(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        out, at, n, get = [], 0, len(piece), self.prefixes.get
        while at < n:
            end, best, size = at + 1, -1, 1
            got = get(piece[at:end])
            while got is not None:
                if got >= 0:
                    best, size = got, end - at
                if end == n:
                    break
                end += 1
                got = get(piece[at:end])
            out.append(best)
            at += size
        return out

    def is_sound(self, token: int) -> bool:
        got = self.sound.get(token)
        if got is None:
            got = self.sound[token] = self.merge(self.bytes[token]) == [token]
        return got

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 60)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sound tokens a and b, side by side, are the encoding of their bytes.

        Undo the latest merge on either side again and again: the border is crossed if, at some
        time, the tokens that touch it merge before the one of them that is made next.  At
        equal rank the left pair goes first.
        """
        n = len(a)
        fine = np.ones(n, bool)
        x, y, live = a.copy(), b.copy(), np.arange(n)
        # ranks of the merges that ended the time of the present x and y: none so far
        x_until, y_until = np.full(n, 1 << 59), np.full(n, 1 << 59)
        while len(live):
            u, v = x[live], y[live]
            r = self._pair_rank(u, v)
            # (x, y) would merge at r; it competes with x's own next merge (to its left, which wins
            # a tie) and with y's (to its right, which loses a tie)
            crossed = (r < x_until[live]) & (r <= y_until[live]) & (r < 1 << 59)
            fine[live[crossed]] = False
            ru, rv = self.rank[u], self.rank[v]
            more = ~crossed & ((ru >= 0) | (rv >= 0))
            live, u, v, ru, rv = live[more], u[more], v[more], ru[more], rv[more]
            # of equal ranks the left merge came first, so the right one is undone first
            undo_left = ru > rv
            k = live[undo_left]
            x_until[k] = ru[undo_left]
            x[k] = self.right[u[undo_left]]
            k = live[~undo_left]
            y_until[k] = rv[~undo_left]
            y[k] = self.left[v[~undo_left]]
        return fine

    def repair(self, tokens: list[int]) -> list[int] | None:
        """Sound tokens of which all neighbours stay apart, by exact merging of those that do not."""
        settled, out, rest, steps = self.settled, [], tokens[::-1], PATIENCE * (len(tokens) + 2)
        while rest:
            token = rest.pop()
            if out:
                last = out[-1]
                pair = last << 32 | token
                made = settled.get(pair, ())
                if made == ():
                    made = self.merge(self.bytes[last] + self.bytes[token])
                    made = settled[pair] = None if made == [last, token] else made
                if made is not None:
                    out.pop()
                    rest += made[::-1]
                    steps -= 1
                    if not steps:
                        return None
                    continue
            out.append(token)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known yet."""
        raw = [p.encode() for p in pieces]
        proposed = [self.propose(p) for p in raw]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        own = np.repeat(np.arange(len(pieces)), counts)
        fails, unsound = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
        tokens, where = np.unique(flat, return_inverse=True)
        sound = np.fromiter((self.is_sound(t) for t in tokens.tolist()), bool, len(tokens))
        unsound[own[~sound[where]]] = True
        inside = np.flatnonzero(own[1:] == own[:-1])
        if len(inside):
            pairs, place = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
            fine = self.apart(pairs >> 32, pairs & 0xFFFFFFFF)
            fails[own[inside[~fine[place]]]] = True
            # the repairs needn't ask again for pairs that stay apart
            asked = np.zeros(len(pairs), bool)
            asked[place[fails[own[inside]]]] = True
            self.settled.update(dict.fromkeys(pairs[fine & asked].tolist()))
        self.failed += int((fails | unsound).sum())
        for k in np.flatnonzero(fails | unsound).tolist():
            proposed[k] = (None if unsound[k] else self.repair(proposed[k])) or self.merge(raw[k])
        flat = np.fromiter(chain.from_iterable(proposed), "<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, proposed), np.int64, len(proposed))) * 4
        self.known.update(zip(pieces, map(flat.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        if len(self.known) > MEMORY:
            self.known = {}
        if len(self.settled) > PAIRS:
            self.settled = {}
        cut = []
        for text in texts:
            pattern = self.pattern if self.other.search(text) else self.common
            if not self.split or not any(s in text for s in self.special):
                cut.append(pattern.findall(text))
                continue
            cut.append([x for p in self.split.split(text) for x in ([p] if p in self.special else pattern.findall(p))])
        for s, i in self.special.items():
            self.known[s] = struct.pack("<I", i)
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def forget(self) -> None:
        """Gives back what was learnt; workers live longer than tasks, and other stages need their memory."""
        self.known, self.settled = {}, {}

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, which Spark uses for many tasks."""
    return Vocabulary(path)


def _codes(path: str, decoded: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                ids = v.encode(part.text.tolist())
                out = {"doc_id": part.doc_id.array, "ids": ids}
                yield pd.DataFrame(out | {"decoded": [v.decode(x) for x in ids]} if decoded else out)
        v.forget()

    return run


def _digests(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _codes(path, True)(batches):
            yield pd.DataFrame({"doc_id": part.doc_id.array, "n_tokens": [len(x) // 4 for x in part.ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in part.ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in part.decoded]})

    return run


def bpe_codes(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers, joined) and, if asked for, the text decoded from them.

    ``path`` is the vocabulary file, readable on every executor.  A null text is empty and has
    no ids; the text of an added token is that token; rows stay as often as they occur; other
    columns are ignored; an empty table gives no rows.
    """
    return map_frames(documents(docs), _codes(path or vocabulary_path(), decoded), "doc_id long, ids binary" + ", decoded string" * decoded)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ``bpe_codes``, taken where the codes are made."""
    return map_frames(documents(table(spark, sf_dir, "documents")), _digests(vocabulary_path()), RESULT)
