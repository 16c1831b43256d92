"""Suffix and common-prefix arrays by external induced sorting with disk-backed queues.

The sort recurses as usual: suffixes that start a rise after a fall (S*) are ordered by the
names of the pieces between them, the string of names is sorted by the same routine, and all
other suffixes are induced from them - first those that fall (L), in ascending order, then
those that rise (S), in descending order.  The priority queue that induction needs is a set of
first-in-first-out regions, one per leading symbol: what is put into a region arrives in its
final order.  Each entry is a tuple (suffix, length of the prefix it shares with the entry
before it).  Prefix lengths are carried through the recursion (counted in names, then turned
into symbols) and through induction, where an entry's value is one more than the least value
met between the two sources.  All values are capped, since callers ask only whether a prefix
has a certain length, and no order is sought beyond the cap.

What grows with the shard - text, kinds, S* places, names, ranks, queues, regions - lives in
files that are mapped into memory, unless it is small; every step works on a block.  Pieces
are named by an external sort: groups of equal beginnings are refined block by block, and a
group above a block is dealt into key ranges first.  A string of names that fits in a block is
sorted there by doubling, which ends the recursion.  The files are scratch space of the task:
they have no name, and vanish with it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np

BATCH = 1 << 17
#: Symbols that stand for no byte: the end of the text, and the end of a piece.
END, STOP, BYTES = 0, 1, 2


def index_type(n: int):
    return np.int64 if n >= 2**31 else np.int32


class Store:
    """Makes arrays, in memory or as mapped files that vanish with the array.

    ``memory`` is about what a task spends: small arrays have a sixteenth of it, a block of
    elements that a step works on at once has a 128th.
    """

    def __init__(self, folder: str | None = None, memory: int = 64 << 20):
        self.folder, self.small, self.block = folder, memory >> 4, max(16, memory >> 7)
        # sources that are pushed at once
        self.batch = min(BATCH, 2 * self.block)

    def array(self, n: int, dtype) -> np.ndarray:
        dtype = np.dtype(dtype)
        if n * dtype.itemsize <= self.small:
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile(dir=self.folder, prefix="queue-") as f:
            os.truncate(f.fileno(), n * dtype.itemsize)
            return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))

    def places(self, n: int) -> np.ndarray:
        """For places of an array of n elements."""
        return self.array(n, index_type(n))

    def blocks(self, n: int, first: int = 0) -> Iterator[tuple[int, int]]:
        for lo in range(first, n, self.block):
            yield lo, min(n, lo + self.block)


class Growing:
    """An array of unknown length: small ones stay in memory, others go on in a file."""

    def __init__(self, store: Store, dtype):
        self.store, self.dtype, self.parts, self.size, self.held, self.file = store, np.dtype(dtype), [], 0, 0, None

    def append(self, part: np.ndarray) -> None:
        self.parts.append(np.asarray(part, self.dtype))
        self.size += len(part)
        self.held += len(part) * self.dtype.itemsize
        if self.held > self.store.small:
            self._flush()

    def _flush(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.store.folder, prefix="queue-")
        for part in self.parts:
            self.file.write(part.tobytes())
        self.parts, self.held = [], 0

    def done(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros(0, self.dtype), *self.parts])
        self._flush()
        with self.file as f:
            f.flush()
            return np.asarray(np.memmap(f, self.dtype, "r+", shape=(self.size,)))


class Minima:
    """Least value of any range of a batch, by doubling; no range is longer than ``longest``."""

    def __init__(self, values: np.ndarray, longest: int):
        n, levels = len(values), max(1, int(longest).bit_length())
        self.rows = np.full((levels, n), 255, np.uint8)
        self.rows[0] = values
        for k in range(1, levels):
            step = 1 << (k - 1)
            np.minimum(self.rows[k - 1, :-step], self.rows[k - 1, step:], out=self.rows[k, :-step])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranges first..end, end excluded; not empty."""
        level = np.frexp((end - first).astype(np.float32))[1] - 1
        return np.minimum(self.rows[level, first], self.rows[level, end - (1 << level)])


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers below 2**44, for at most BATCH keys."""
    if keys.dtype.itemsize <= 2:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.int64) << 18) | np.arange(len(keys))
    packed.sort()
    return packed & ((1 << 18) - 1)


def counted(store: Store, sigma: int, parts: Iterable[np.ndarray]) -> np.ndarray:
    """How often each symbol occurs."""
    total = store.array(sigma, np.int64)
    for part in parts:
        if sigma <= store.block:
            total += np.bincount(part, minlength=sigma)
        else:
            seen, n = np.unique(part, return_counts=True)
            total[seen] += n
    return total


def begins(store: Store, sizes: np.ndarray) -> np.ndarray:
    """Where the region of each size begins, and the end of the last one."""
    out, total = store.array(len(sizes) + 1, np.int64), 0
    for lo, hi in store.blocks(len(sizes)):
        np.cumsum(sizes[lo:hi], out=out[lo + 1 : hi + 1])
        out[lo + 1 : hi + 1] += total
        total = int(out[hi])
    return out


class Queue:
    """One region per symbol; its size is known, so it is full when all its entries arrived."""

    def __init__(self, store: Store, sizes: np.ndarray, kind):
        n, self.batch = len(sizes), store.batch
        self.begin = begins(store, sizes)
        self.tail = store.array(n, np.int64)
        for lo, hi in store.blocks(n):
            self.tail[lo:hi] = self.begin[lo:hi]
        self.at = store.array(int(self.begin[-1]), kind)
        self.lcp = store.array(int(self.begin[-1]), np.uint8)
        # what the sources since the last entry of a region share; it holds for one leading symbol
        self.carry = store.array(n, np.uint8)
        self.stamp = store.array(n, np.int32)
        self.turn = 0
        # regions that have a carry in this turn
        self.carried = np.zeros(0, np.int64)

    def full_until(self, c: int) -> int:
        """The next region from ``c`` on that isn't full yet, as far as a batch reaches."""
        n, step, start = len(self.tail), 64, c
        while c < n and c - start < self.batch:
            part = self.tail[c : c + step] < self.begin[c + 1 : c + step + 1]
            k = int(part.argmax())
            if part[k]:
                return c + k
            c, step = c + len(part), min(4096, step * 4)
        return min(c, n)

    def put(self, symbol: np.ndarray, child: np.ndarray, where: np.ndarray, lcp: np.ndarray, fresh: bool, more: bool, cap: int) -> None:
        """Children of a batch of sources: ``where`` says which source, ``lcp`` is of all sources.

        ``fresh``: the batch starts a new leading symbol, so what was put before shares one
        symbol only.  ``more``: the leading symbol goes on in the next batch.
        """
        if fresh:
            self.turn += 1
            self.carried = self.carried[:0]
        if len(symbol):
            order = stable_order(symbol)
            s, w = symbol[order], where[order]
            head = np.empty(len(s), bool)
            head[0] = True
            np.not_equal(s[1:], s[:-1], out=head[1:])
            heads = np.flatnonzero(head)
            sizes = np.empty_like(heads)
            np.subtract(heads[1:], heads[:-1], out=sizes[:-1])
            sizes[-1] = len(s) - heads[-1]
            which = s[heads].astype(np.int64)
            first = np.empty(len(s), np.int64)
            first[1:] = w[:-1] + 1
            first[heads] = 0
            minima = Minima(lcp, max(int((w + 1 - first).max()), len(lcp) if more else 1))
            value = minima.of(first, w + 1)
            value[heads] = np.minimum(value[heads], np.where(self.stamp[which] == self.turn, self.carry[which], 0))
            value = np.minimum(value, cap - 1) + np.uint8(1)
            tail = self.tail[which]
            value[heads[tail == self.begin[which]]] = 0
            place = np.repeat(tail - heads, sizes) + np.arange(len(s))
            self.at[place] = child[order]
            self.lcp[place] = value
            self.tail[which] = tail + sizes
        if more and len(lcp):
            self.carry[self.carried] = np.minimum(self.carry[self.carried], lcp.min())
            if len(symbol):
                last = w[heads + sizes - 1] + 1
                rest = np.full(len(which), 255, np.uint8)
                inside = last < len(lcp)
                if inside.any():
                    rest[inside] = minima.of(last[inside], np.full(int(inside.sum()), len(lcp)))
                self.carry[which] = rest
                new = which[self.stamp[which] != self.turn]
                self.stamp[which] = self.turn
                self.carried = np.concatenate([self.carried, new])


def _classify(text: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes rise, and where the run of equal symbols at each place ends."""
    n = len(text)
    rises, run_end = store.array(n, bool), store.places(n)
    # of the run that goes on behind the block; the last suffix counts as rising
    end, up = n - 1, True
    for hi in range(n, 0, -store.block):
        lo = max(0, hi - store.block)
        part = text[lo : min(hi + 1, n)]
        change = np.flatnonzero(part[1:] != part[:-1])
        ends, ups = lo + change, part[change] < part[change + 1]
        if hi == n or not len(ends) or ends[-1] != hi - 1:
            ends, ups = np.append(ends, end), np.append(ups, up)
        lengths = np.diff(np.concatenate([[lo - 1], np.minimum(ends, hi - 1)]))
        rises[lo:hi] = np.repeat(ups, lengths)
        run_end[lo:hi] = np.repeat(ends, lengths)
        end, up = int(run_end[lo]), bool(rises[lo])
    return rises, run_end


def _stars(rises: np.ndarray, store: Store) -> np.ndarray:
    """Places that rise behind a place that falls."""
    parts = lambda: (lo + np.flatnonzero(rises[lo:hi] & ~rises[lo - 1 : hi - 1]) for lo, hi in store.blocks(len(rises), 1))
    stars, at = store.array(sum(map(len, parts())), index_type(len(rises))), 0
    for part in parts():
        stars[at : at + len(part)] = part
        at += len(part)
    return stars


def _deal(keys: np.ndarray, ids: np.ndarray, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Many (key, id) in ascending order of keys, block by block: dealt into key ranges, which are sorted one by one."""
    n = len(keys)
    if n <= store.block:
        order = np.argsort(keys, kind="stable")
        yield keys[order], ids[order]
        return
    sample = np.sort(keys[:: max(1, n * 4 // store.block)])
    ranges = max(2, min(len(sample), 4 * n // store.block))
    cuts = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges])
    # odd ranges hold one key alone, which may be any number of rows and needs no sort
    which = lambda k: np.searchsorted(cuts, k, side="left") + np.searchsorted(cuts, k, side="right")
    sizes = counted(store, 2 * len(cuts) + 1, (which(keys[lo:hi]) for lo, hi in store.blocks(n)))
    begin = begins(store, sizes)
    tail, keys_out, ids_out = begin[:-1].copy(), store.array(n, keys.dtype), store.array(n, ids.dtype)
    for lo, hi in store.blocks(n):
        part = which(keys[lo:hi])
        order = np.argsort(part, kind="stable")
        p = part[order]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        count = np.diff(np.append(head, len(p)))
        place = np.repeat(tail[p[head]] - head, count) + np.arange(len(p))
        keys_out[place], ids_out[place] = keys[lo:hi][order], ids[lo:hi][order]
        tail[p[head]] += count
    for r in range(len(sizes)):
        a, b = int(begin[r]), int(begin[r + 1])
        if r % 2:
            for lo, hi in store.blocks(b, a):
                yield keys_out[lo:hi], ids_out[lo:hi]
        elif b > a:
            yield from _deal(keys_out[a:b], ids_out[a:b], store)


def _name(text: np.ndarray, rises: np.ndarray, stars: np.ndarray, sigma: int, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The pieces from each S* suffix to the next one in order of their first ``cap`` symbols; where a new name begins."""
    m, n = len(stars), len(text)
    bits = int(2 * sigma + 1).bit_length()
    per = max(1, 63 // bits)

    def lengths(piece: np.ndarray) -> np.ndarray:
        return np.where(piece + 1 < m, stars[np.minimum(piece + 1, m - 1)], n - 1) - stars[piece] + 1

    def keys(piece: np.ndarray, offset: int) -> np.ndarray:
        key, base, size = np.zeros(len(piece), np.int64), stars[piece].astype(np.int64) + offset, lengths(piece)
        for j in range(per):
            place = np.minimum(base + j, n - 1)
            symbol = np.where(offset + j < size, 2 * text[place].astype(np.int64) + rises[place] + 1, 0)
            key = (key << bits) | symbol
        return key

    order, heads = store.places(m), store.array(m, bool)
    for lo, hi in store.blocks(m):
        order[lo:hi] = np.arange(lo, hi)
    heads[:1] = True
    # places of ``order`` in groups that are to be refined; each group is a run of them
    active, offset = order.copy() if m <= store.block else store.array(m, order.dtype), 0
    if m > store.block:
        for lo, hi in store.blocks(m):
            active[lo:hi] = np.arange(lo, hi)

    def refined(places: np.ndarray, piece: np.ndarray, head: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Writes sorted pieces to their places; returns the places that are not alone in their group."""
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        order[places], heads[places] = piece, new
        return new

    while len(active):
        left = Growing(store, active.dtype)

        def keep(places: np.ndarray, new: np.ndarray, closed: bool, left=left, until=offset + per) -> None:
            """Places of groups of two or more that go on behind ``until``; ``closed``: no group reaches over the end."""
            alone = new & np.append(new[1:], closed)
            rest = places[~alone]
            left.append(rest[(lengths(order[rest]) > until) & (until < cap)])

        at = 0
        while at < len(active):
            end = min(len(active), at + store.block)
            head = heads[active[at:end]]
            if end < len(active) and not heads[active[end]]:
                inside = np.flatnonzero(head)
                if inside[-1] > 0:
                    end, head = at + int(inside[-1]), head[: inside[-1]]
                else:
                    # one group above a block
                    while end < len(active):
                        more = np.flatnonzero(heads[active[end : end + store.block]])
                        if len(more):
                            end += int(more[0])
                            break
                        end = min(len(active), end + store.block)
                    many, ids = store.array(end - at, np.int64), store.array(end - at, order.dtype)
                    for lo, hi in store.blocks(end, at):
                        ids[lo - at : hi - at] = order[active[lo:hi]]
                        many[lo - at : hi - at] = keys(ids[lo - at : hi - at], offset)
                    before, put = None, at
                    for key, piece in _deal(many, ids, store):
                        first = np.zeros(len(key), bool)
                        first[0] = before is None or key[0] != before
                        refined(active[put : put + len(key)], piece, first, key)
                        before, put = key[-1], put + len(key)
                    for lo, hi in store.blocks(end, at):
                        new = heads[active[lo:hi]]
                        keep(active[lo:hi], new, hi == end or bool(heads[active[hi]]))
                    at = end
                    continue
            places = active[at:end]
            piece = order[places]
            key = keys(piece, offset)
            take = np.lexsort((key, np.cumsum(head)))
            new = refined(places, piece[take], head, key[take])
            keep(places, new, True)
            at = end
        active, offset = left.done(), offset + per
    return order, heads


def _star_lcp(text, stars, order, shared, cap, store) -> np.ndarray:
    """Names that neighbours share, as symbols: whole pieces, then the start of the differing ones."""
    m, n = len(order), len(text)
    out = store.array(m, np.uint8)
    for lo, hi in store.blocks(m, 1):
        a, b = order[lo - 1 : hi - 1].astype(np.int64), order[lo:hi].astype(np.int64)
        k = np.minimum(shared[lo:hi].astype(np.int64), m - 1 - np.maximum(a, b))
        first = stars[a].astype(np.int64)
        matched = stars[a + k] - first
        x, y = first + matched, stars[b] + matched
        active = np.flatnonzero(matched < cap)
        while len(active):
            active = active[(x[active] < n) & (y[active] < n)]
            active = active[text[x[active]] == text[y[active]]]
            x[active] += 1
            y[active] += 1
            matched[active] += 1
            active = active[matched[active] < cap]
        out[lo:hi] = np.minimum(matched, cap)
    return out


def _direct(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``suffix_array`` yields, by doubling, for a string that fits in a block."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, k = [(1, rank)], 1
    while k < cap and int(rank.max(initial=0)) < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
        k *= 2
        levels.append((k, rank))
    order = np.argsort(rank, kind="stable")
    x, y, lcp = order[1:].copy(), order[:-1].copy(), np.zeros(max(0, n - 1), np.int64)
    for k, rank in reversed(levels):
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[rank[x[inside]] == rank[y[inside]]]
        for side in (x, y, lcp):
            side[same] += k
    return order[::-1], np.concatenate([[0], np.minimum(lcp, cap)[::-1]]).astype(np.uint8)


def suffix_array(text: np.ndarray, sigma: int, cap: int, store: Store, names: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (suffix, prefix shared with the suffix before) in *descending* order.

    ``text`` holds symbols below ``sigma`` and ends in the only 0.  The value beside a suffix
    is what it shares with the next larger one, at most ``cap`` (below 255).  ``names``: the
    text is a string of names, which is sorted directly if it fits in a block.
    """
    n, batch = len(text), store.batch
    if names and n <= store.block:
        yield _direct(text, cap)
        return
    rises, run_end = _classify(text, store)
    stars = _stars(rises, store)
    m = len(stars)
    order, heads = _name(text, rises, stars, sigma, cap, store)
    distinct = int(np.count_nonzero(heads))
    shared = store.array(m, np.uint8)
    if distinct == m or cap == 1:
        for lo, hi in store.blocks(m):
            shared[lo:hi] = ~heads[lo:hi]
    else:
        # a piece holds two symbols or more besides the first of the next one
        reduced, name = store.array(m + 1, np.int64 if distinct >= 2**31 - 1 else np.int32), 0
        for lo, hi in store.blocks(m):
            here = name + np.cumsum(heads[lo:hi])
            reduced[order[lo:hi]] = here
            name = int(here[-1])
        end = m
        for part, value in suffix_array(reduced, distinct + 1, (cap + 1) // 2, store, True):
            # values come beside the smaller neighbour; the last suffix is the end of the string, and is left out
            lo = max(0, end - len(part))
            order[lo:end] = part[: end - lo][::-1]
            # each value belongs to the entry after its own, in ascending order
            at = end - len(part) + 1
            shared[at : end + 1] = value[::-1][: min(end + 1, m) - at]
            end -= len(part)
        del reduced
    shared[:1] = 0
    star_lcp = _star_lcp(text, stars, order, shared, cap, store)
    star_at = store.array(m, stars.dtype)
    for lo, hi in store.blocks(m):
        star_at[lo:hi] = stars[order[lo:hi]]
    del order, shared, heads
    star_begin = begins(store, counted(store, sigma, (text[stars[lo:hi]] for lo, hi in store.blocks(m))))

    def run(at: np.ndarray) -> np.ndarray:
        return np.minimum(run_end[at] - at + 1, cap)

    def children(at: np.ndarray, rise: bool) -> tuple[np.ndarray, np.ndarray]:
        where = np.flatnonzero(at > 0)
        child = at[where].astype(np.int64) - 1
        fit = rises[child] == rise
        return where[fit], child[fit]

    def push(queue: Queue, at: np.ndarray, lcp: np.ndarray, rise: bool, fresh: bool, more: bool, flip: int = 0) -> None:
        for k in range(0, max(1, len(at)), batch):
            a, v = at[k : k + batch], lcp[k : k + batch]
            where, child = children(a, rise)
            symbol = text[child]
            queue.put(flip - symbol if flip else symbol, child, where, v, fresh and k == 0, more or k + batch < len(at), cap)

    def joined(one, one_sizes, two, two_sizes):
        """Sources of whole symbols, few in all: for each symbol all of one, then all of two, with what neighbours share."""
        symbols = np.arange(len(one_sizes))
        key = np.concatenate([np.repeat(symbols * 2, one_sizes), np.repeat(symbols * 2 + 1, two_sizes)])
        order = np.argsort(key, kind="stable")
        at = np.concatenate([one[0], two[0]])[order].astype(np.int64)
        lcp = np.concatenate([one[1], two[1]])[order]
        key = key[order]
        if len(at):
            turn = np.concatenate([[True], key[1:] != key[:-1]])
            lcp[turn] = 0
            meet = np.flatnonzero(turn[1:] & (key[1:] >> 1 == key[:-1] >> 1)) + 1
            lcp[meet] = np.minimum(run(at[meet - 1]), run(at[meet]))
        return at, lcp

    def streamed(parts: list[tuple[Callable, int, int]], last: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
        """Sources of one symbol in batches; the parts follow each other, after the suffix ``last`` if there is one."""
        steps = [(get, lo, min(hi, lo + batch), lo == begin) for get, begin, hi in parts for lo in range(begin, hi, batch)]
        for k, (get, lo, hi, turn) in enumerate(steps):
            at, lcp = get(lo, hi)
            at, lcp = at.astype(np.int64), lcp.copy()
            if turn:
                lcp[0] = 0 if last is None else min(int(run(np.array([last]))[0]), int(run(at[:1])[0]))
            fresh = last is None
            last = int(at[-1])
            yield at, lcp, fresh, k + 1 < len(steps)

    star_range = lambda lo, hi: (star_at[lo:hi], star_lcp[lo:hi])

    # L suffixes, ascending
    falls = Queue(store, counted(store, sigma, (text[lo:hi][~rises[lo:hi]] for lo, hi in store.blocks(n))), index_type(n))
    falls_range = lambda lo, hi: (falls.at[lo:hi], falls.lcp[lo:hi])
    c = 0
    while c < sigma:
        stop = falls.full_until(c)
        if stop > c:
            ends = falls.begin[c + 1 : stop + 1] + star_begin[c + 1 : stop + 1]
            stop = min(stop, max(c + 1, int(np.searchsorted(ends, falls.begin[c] + star_begin[c] + batch)) + c))
            la, lb, sa, sb = (int(x) for x in (falls.begin[c], falls.begin[stop], star_begin[c], star_begin[stop]))
            if stop - c == 1:
                for at, lcp, fresh, more in streamed([(falls_range, la, lb), (star_range, sa, sb)], None):
                    push(falls, at, lcp, False, fresh, more)
            else:
                at, lcp = joined(falls_range(la, lb), np.diff(falls.begin[c : stop + 1]), star_range(sa, sb), np.diff(star_begin[c : stop + 1]))
                push(falls, at, lcp, False, True, False)
            c = stop
            continue
        # the region of c is still filling from itself: take what has arrived, round by round
        head, fresh, last = int(falls.begin[c]), True, None
        while head < falls.begin[c + 1]:
            tail = min(int(falls.tail[c]), head + batch)
            at, lcp = falls.at[head:tail].astype(np.int64), falls.lcp[head:tail].copy()
            if fresh:
                lcp[:1] = 0
            push(falls, at, lcp, False, fresh, True)
            head, fresh, last = tail, False, int(at[-1])
        for at, lcp, _, more in streamed([(star_range, int(star_begin[c]), int(star_begin[c + 1]))], last):
            push(falls, at, lcp, False, False, more)
        c += 1

    # S suffixes, descending; symbol c has the region sigma - 1 - c
    flip = sigma - 1
    climbs = Queue(store, counted(store, sigma, (text[lo:hi][rises[lo:hi]] for lo, hi in store.blocks(n)))[::-1], index_type(n))
    # the end of the text is the least suffix of all and has no source
    climbs.at[climbs.begin[flip]] = n - 1
    climbs.lcp[climbs.begin[flip]] = 0
    climbs.tail[flip] += 1
    l_begin, n_falls = falls.begin, int(falls.begin[-1])
    climbs_range = lambda lo, hi: (climbs.at[lo:hi], climbs.lcp[lo:hi])

    def falling(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """L suffixes in descending order, with what each shares with the larger one."""
        a, b = n_falls - hi, n_falls - lo
        at, lcp = falls.at[a:b][::-1], np.zeros(b - a, np.uint8)
        more = falls.lcp[a + 1 : min(b + 1, n_falls)]
        lcp[b - a - len(more) :] = more[::-1]
        return at, lcp

    # where the L suffixes of flipped symbols c..stop lie in descending order
    l_ends = lambda c, stop: n_falls - l_begin[flip - np.arange(c - 1, stop)]
    c = 0
    while c < sigma:
        stop = climbs.full_until(c)
        if stop > c:
            down = l_ends(c, stop)
            ends = climbs.begin[c + 1 : stop + 1] + down[1:]
            stop = min(stop, max(c + 1, int(np.searchsorted(ends, climbs.begin[c] + down[0] + batch)) + c))
            a, b, la, lb = int(climbs.begin[c]), int(climbs.begin[stop]), int(down[0]), int(down[stop - c])
            if stop - c == 1:
                for at, lcp, fresh, more in streamed([(climbs_range, a, b), (falling, la, lb)], None):
                    push(climbs, at, lcp, True, fresh, more, flip)
                    yield at, lcp
            else:
                at, lcp = joined(climbs_range(a, b), np.diff(climbs.begin[c : stop + 1]), falling(la, lb), np.diff(down[: stop - c + 1]))
                push(climbs, at, lcp, True, True, False, flip)
                yield at, lcp
            c = stop
            continue
        head, fresh, last = int(climbs.begin[c]), True, None
        while head < climbs.begin[c + 1]:
            tail = min(int(climbs.tail[c]), head + batch)
            at, lcp = climbs.at[head:tail].astype(np.int64), climbs.lcp[head:tail].copy()
            if fresh:
                lcp[:1] = 0
            push(climbs, at, lcp, True, fresh, True, flip)
            yield at, lcp
            head, fresh, last = tail, False, int(at[-1])
        down = l_ends(c, c + 1)
        for at, lcp, _, more in streamed([(falling, int(down[0]), int(down[1]))], last):
            push(climbs, at, lcp, True, False, more, flip)
            yield at, lcp
        c += 1


class Shard:
    """Pieces of text that are searched together for strings of ``width`` bytes that start twice."""

    def __init__(self, width: int, store: Store):
        self.width, self.store = width, store
        self.text, self.left = Growing(store, np.uint16), Growing(store, np.uint8)
        self.begin = Growing(store, np.int64)
        self.fade = np.arange(width, -1, -1).astype(np.uint8)

    def add(self, piece: bytes) -> None:
        self.begin.append(np.array([self.text.size]))
        self.text.append(np.append(np.frombuffer(piece, np.uint8).astype(np.uint16) + BYTES, STOP))
        # bytes to the end of the piece, at most ``width``
        self.left.append(np.concatenate([np.full(max(0, len(piece) - self.width), self.width), self.fade[-len(piece) - 1 :]]))

    def repeated(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of (piece, first, run): maximal runs of starts that are repeated, in order.  ``width`` is below 255."""
        self.text.append(np.array([END]))
        self.left.append(np.array([0]))
        text, left, begin = self.text.done(), self.left.done(), self.begin.done()
        n = len(text)
        hit, before = self.store.array(n, bool), -1
        for suffix, lcp in suffix_array(text, 256 + BYTES, self.width, self.store):
            if not len(suffix):
                continue
            whole = np.concatenate([[before], suffix])
            fits = left[whole] >= self.width
            pair = np.flatnonzero((lcp >= self.width) & fits[1:] & fits[:-1] & (whole[:-1] >= 0))
            hit[whole[pair]] = True
            hit[whole[pair + 1]] = True
            before = int(suffix[-1])
        open_, run = None, False
        for lo, hi in self.store.blocks(n):
            here = hit[lo:hi].view(np.int8)
            edge = np.diff(np.concatenate([[int(run)], here]))
            starts, ends = lo + np.flatnonzero(edge == 1), lo + np.flatnonzero(edge == -1)
            if open_ is not None:
                starts = np.concatenate([[open_], starts])
            run = bool(here[-1])
            # a run never holds the end of a piece; one that reaches over the block ends in a later one
            open_, starts = (int(starts[-1]), starts[:-1]) if run else (None, starts)
            if len(starts):
                piece = np.searchsorted(begin, starts, side="right") - 1
                yield piece, starts - begin[piece], ends - starts


def repeated_starts(pieces: Iterable[bytes], width: int, store: Store) -> list[tuple[int, int, int]]:
    """(piece, first, run) of the starts of ``width``-byte strings that start elsewhere too."""
    shard = Shard(width, store)
    for piece in pieces:
        shard.add(piece)
    return [x for batch in shard.repeated() for x in zip(*(c.tolist() for c in batch), strict=True)]
