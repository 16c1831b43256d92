"""Minimizer anchors: which windows of a sequence can equal a window elsewhere.

A window of ``width`` symbols holds ``width - gram + 1`` grams; the leftmost gram with the
smallest hash is its anchor.  Equal windows have equal anchors at the same offset, so windows
that could be equal always meet under one anchor hash.  Each window start belongs to exactly
one anchor; the starts of one anchor are consecutive and form a *block*, which covers the
symbols from its first start to the end of its last window.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products become evenly spread."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * _BASES[0]
    return x ^ (x >> np.uint64(32))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        base = int(_BASES[which])
        if inverse:
            base = pow(base, -1, 1 << 64)
        steps = np.full(max(1 << 16, 1 << int(n).bit_length()), base, np.uint64)
        steps[0] = 1
        got = _POWERS[which, inverse] = np.cumprod(steps)
    return got[:n]


class Prefix:
    """Polynomial hashes modulo 2**64 of any range of ``values``, by prefix sums."""

    def __init__(self, values: np.ndarray, which: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(which, n, False), out=self.sums[1:])
        self.inverse = _powers(which, n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k]


def leftmost_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each of the ``len - w + 1`` windows, the place of its leftmost smallest hash.

    Candidates are found by blockwise running minima from both sides, so the work per
    element doesn't depend on ``w``.
    """
    n = len(hashes)
    pad = -n % w
    h = np.concatenate([hashes, np.full(pad, np.uint64(2**64 - 1))]) if pad else hashes
    rows = h.reshape(-1, w)
    right = np.minimum.accumulate(rows, axis=1)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    place = np.arange(len(h)).reshape(-1, w)
    # the leftmost place of the running minimum: from the left it changes only on strict falls
    first = np.ones_like(rows, dtype=bool)
    first[:, 1:] = right[:, 1:] < right[:, :-1]
    right_at = np.maximum.accumulate(np.where(first, place, 0), axis=1).ravel()
    # from the right it moves whenever the value is at most the minimum of what follows
    last = np.ones_like(rows, dtype=bool)
    last[:, :-1] = rows[:, :-1] <= left[:, 1:]
    left_at = np.minimum.accumulate(np.where(last, place, len(h))[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    a, b = left.ravel()[:m], right.ravel()[w - 1 : w - 1 + m]
    return np.where(a <= b, left_at[:m], right_at[w - 1 : w - 1 + m])


def batches(symbols: np.ndarray, lengths: np.ndarray, size: int):
    """Runs of whole sequences of about ``size`` symbols: (first sequence, end, first symbol, end)."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield first, end, int(base), int(ends[end - 1])
        first = end


def blocks(symbols: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None, width: int, gram: int):
    """Blocks of many sequences of symbols: (sequence, anchor, digest, first start, starts).

    ``symbols`` are those of all sequences, joined, as places in ``hashes``, or hashes themselves.  Sequences shorter
    than ``width`` have no block.  ``digest`` is a second, independent hash of all symbols that
    the block covers.
    """
    parts = []
    with np.errstate(over="ignore"):
        for one, end, lo, hi in batches(symbols, lengths, 1 << 18):
            n = hi - lo
            if n < width:
                continue
            values = symbols[lo:hi] if hashes is None else hashes[symbols[lo:hi]]
            grams = mix(Prefix(values, 0).grams(gram))
            at = leftmost_minima(grams, width - gram + 1)
            own = np.repeat(np.arange(one, end), lengths[one:end])[: len(at)]
            last = np.repeat(np.cumsum(lengths[one:end]), lengths[one:end])[: len(at)]
            valid = np.flatnonzero(np.arange(len(at)) + width <= last)
            if not len(valid):
                continue
            a, o = at[valid], own[valid]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])]))
            count = np.append(head[1:], len(a)) - head
            start = valid[head]
            digest = mix(Prefix(values, 1).of(start, start + count + width - 1) + count.astype(np.uint64))
            begin = np.cumsum(lengths[one:end]) - lengths[one:end]
            parts.append((o[head], grams[a[head]].view(np.int64), digest.view(np.int64), start - begin[o[head] - one], count))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
