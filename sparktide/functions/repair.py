"""Repair of times and values of one series, for ``numeric.apply``.  Times are microseconds.

Choices where other engines are in doubt: the median step is that of all steps; steps that no
point takes are NaN at their own time; an autoregression that does not fade raises; the
likelihood fill solves for its optimum instead of iterating towards it.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

from .quality import deviation

#: What it costs to insert or drop a point, as milliseconds that a point may be moved instead.
EDIT = 100_000
MS = 1000
TINY = 1e-12


def usual_step(t, method: str = "median") -> int:
    """The step of a series that should be regular: median, most frequent, or mean of the largest of three clusters."""
    step = np.diff(t)
    if method == "median":
        return int(np.median(step))
    if method == "mode":
        return Counter(step.tolist()).most_common(1)[0][0]
    if method != "cluster":
        raise ValueError(f"no such method of repair: {method}")
    low, high = int(step.min()), int(step.max())
    means, own = low + np.arange(1, 4) * (high - low) // 4, None
    while True:
        nearest = np.abs(step[:, None] - means).argmin(axis=1)
        if own is not None and (nearest == own).all():
            break
        own = nearest
        for k in range(3):
            if (own == k).any():
                means[k] = step[own == k].sum() // (own == k).sum()
    return int(means[np.bincount(own, minlength=3).argmax()])


def _start(t, step: int) -> int:
    """Where a grid of ``step`` begins that most points lie on, at the first point or before it."""
    rest = Counter((t % step).tolist()).most_common(1)[0][0]
    return int(t[0] - (t[0] - rest) % step)


def timestamp_repair(t, v, interval=0, method="median"):
    """Points on a regular grid, so that moving, inserting and dropping points costs least; inserted ones are NaN.

    All ways to align the points with the grid are compared, one anti-diagonal after the other;
    that takes a byte for each pair of a point and a step.
    """
    method = method.lower()
    step = int(interval) or (usual_step(t, method) if len(t) > 1 else 0)
    if len(t) <= 2 or step <= 0:
        return t, v
    start = _start(t, step)
    grid = start + step * np.arange(int(-(-(t[-1] - start) // step)) + 1)
    n, m, edit = len(grid), len(t), EDIT * MS
    move, insert, drop = 0, 1, 2
    ways = np.full((n + 1, m + 1), insert, np.int8)
    ways[0, 1:] = drop
    before = last = np.zeros(n + 1, np.int64)
    for d in range(1, n + m + 1):
        now = np.zeros(n + 1, np.int64)
        lo, hi = max(0, d - m), min(n, d)
        if lo == 0:
            now[0] = edit * d
        if hi == d:
            now[d] = edit * d
        i = np.arange(max(1, lo), min(hi, d - 1) + 1)
        if len(i):
            j = d - i
            inserted, dropped = last[i - 1], last[i]
            cost, way = np.where(inserted < dropped, inserted, dropped) + edit, np.where(inserted < dropped, insert, drop)
            away = np.abs(t[j - 1] - grid[i - 1])
            moved = before[i - 1] + away
            better = (moved < cost) | (away == 0)
            now[i], ways[i, j] = np.where(better, moved, cost), np.where(better, move, way)
        before, last = last, now
    out, i, j = np.full(n, np.nan), n, m
    while i and j:
        way = ways[i, j]
        if way == move:
            out[i - 1] = v[j - 1]
        i, j = i - (way != drop), j - (way != insert)
    return grid, out


def _speeds(t, v):
    """Changes of value in a millisecond: the steps, the median speed's bounds and the window of the repair."""
    step = np.diff(t) / MS
    speed = np.diff(v) / step
    mid, sigma = float(np.nanmedian(speed)), deviation(speed[~np.isnan(speed)])
    return mid - 3 * sigma, mid + 3 * sigma, 5 * float(np.median(step))


def screen(t, v, low=None, high=None):
    """Repair by speed bounds (in a millisecond): each point moves to the median of what its followers allow."""
    if len(v) < 3:
        return t, v
    smin, smax, width = _speeds(t, v)
    smin, smax = smin if low is None else low, smax if high is None else high
    x, out = t / MS, v.copy()
    ends = np.searchsorted(x, x + width, side="right")
    for i in range(len(v)):
        near = slice(i + 1, max(i + 1, int(ends[i])))
        back = x[i] - x[near]
        allowed = np.concatenate([[out[i]], out[near] + smin * back, out[near] + smax * back])
        mid = np.sort(allowed)[len(back)]
        if i:
            d = x[i] - x[i - 1]
            mid = max(min(mid, out[i - 1] + smax * d), out[i - 1] + smin * d)
        out[i] = mid
    return t, out


def ls_greedy(t, v, center=0.0, sigma=None):
    """The point with the largest change of speed is moved, again and again, until all changes lie within three deviations."""
    out, n = v.copy(), len(v)
    if n < 3:
        return t, out
    step = np.diff(t) / MS
    change = lambda k: (out[k + 1] - out[k]) / step[k] - (out[k] - out[k - 1]) / step[k - 1] - center
    if sigma is None:
        sigma = deviation(np.diff(np.diff(out) / step))
    now = [0.0, *(change(k) for k in range(1, n - 1)), 0.0]
    heap = [(-abs(u), k) for k, u in enumerate(now) if abs(u) > 3 * sigma]
    heapq.heapify(heap)
    while heap:
        size, k = heapq.heappop(heap)
        # entries of points that changed since are out of date
        if -size != abs(now[k]):
            continue
        if -size < max(TINY, 3 * sigma):
            break
        by = -size if sigma < TINY else max(sigma, -size / 3)
        out[k] += np.copysign(by * step[k] * step[k - 1] / (step[k] + step[k - 1]), now[k])
        for q in range(max(1, k - 1), min(n - 2, k + 1) + 1):
            now[q] = change(q)
            if abs(now[q]) > 3 * sigma:
                heapq.heappush(heap, (-abs(now[q]), q))
    return t, out


# values that are not there


def fill_ar(t, v):
    """An autoregression of order one, NaN counted as 0 when it is fitted; a first NaN becomes the mean."""
    good = ~np.isnan(v)
    if not good.any():
        return t, v
    x = np.where(good, v, 0.0)
    power = float((x[:-1] ** 2).sum())
    theta = float((x[:-1] * x[1:]).sum()) / power if power else np.inf
    both = good[:-1] & good[1:]
    if abs(theta) >= 1 or not both.any():
        raise ValueError("an autoregression of order one doesn't fit; choose another method")
    drift = float((v[1:] - theta * v[:-1])[both].mean())
    out = v.copy()
    for i in np.flatnonzero(~good).tolist():
        out[i] = theta * out[i - 1] + drift if i else v[good].mean()
    return t, out


def fill_ma(t, v, window=5):
    """The mean of the values that a running window has met so far; it starts with the first ``window - 1``."""
    n, half = len(v), (window - 1) // 2
    good = ~np.isnan(v)
    total, count = (np.concatenate([[0], np.cumsum(x)]) for x in (np.where(good, v, 0.0), good))
    steps = np.clip(np.minimum(np.arange(n) - 1, n - half - 2) - half, 0, None)
    end = np.minimum(window - 1 + steps, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return t, np.where(good, v, total[end] / count[end])


def fill_screen(t, v):
    """The median of what the values within the window behind allow at the usual speeds, kept near the value before."""
    if len(v) < 3 or np.isnan(v).all():
        return t, v
    smin, smax, width = _speeds(t, v)
    x, out = t / MS, v.copy()
    for i in np.flatnonzero(np.isnan(v)).tolist():
        near = np.arange(i + 1, np.searchsorted(x, x[i] + width, side="right"))
        near = near[~np.isnan(v[near])]
        if not len(near):
            continue
        back = x[i] - x[near]
        mid = np.sort(np.concatenate([v[near] + smin * back, v[near] + smax * back]))[len(near)]
        if i:
            d = x[i] - x[i - 1]
            mid = max(min(mid, out[i - 1] + smax * d), out[i - 1] + smin * d)
        out[i] = mid
    return t, out


def fill_likelihood(t, v):
    """Values that make the sum of squared changes of speed least; NaN at the ends stays."""
    good = np.flatnonzero(~np.isnan(v))
    if len(good) < 2:
        return t, v
    lo, hi = int(good[0]), int(good[-1]) + 1
    x, y, out = t[lo:hi] / MS, v[lo:hi].copy(), v.copy()
    gaps = np.flatnonzero(np.isnan(y))
    if not len(gaps) or len(y) < 3:
        return t, out
    step = np.diff(x)
    # gaps with fewer than two values between them depend on each other
    for part in np.split(gaps, np.flatnonzero(np.diff(gaps) > 2) + 1):
        rows = np.arange(max(1, part[0] - 1), min(len(y) - 2, part[-1] + 1) + 1)
        first = int(rows[0] - 1)
        a = np.zeros((len(rows), int(rows[-1]) + 2 - first))
        k = np.arange(len(rows))
        a[k, rows - 1 - first], a[k, rows + 1 - first] = 1 / step[rows - 1], 1 / step[rows]
        a[k, rows - first] = -1 / step[rows - 1] - 1 / step[rows]
        known = np.ones(a.shape[1], bool)
        known[part - first] = False
        here = y[first : first + a.shape[1]]
        y[part] = np.linalg.lstsq(a[:, ~known], -a[:, known] @ here[known], rcond=None)[0]
    out[lo:hi] = y
    return t, out


FILLS = {"ar": fill_ar, "ma": fill_ma, "screen": fill_screen, "likelihood": fill_likelihood}


def master_repair(t, *columns, master=(), omega=None, eta=None, k=None, output=1):
    """Column ``output`` of each row, replaced by that of the master tuple that is nearest among smooth ones.

    Candidates are the ``k`` master tuples nearest to the row and to the repaired rows within
    ``omega`` before it; smooth ones lie within ``eta`` of all of those.  Without any, the
    nearest candidate is taken.  Defaults: ten median steps, the 0.9973 quantile of distances
    of rows that near, and the least k of 2 to 5 whose neighbours reach beyond ``eta``.
    """
    p, m = np.column_stack(columns).astype(float), np.asarray(master, float)
    if not len(p) or not len(m):
        return t, p[:, output - 1]
    scale = p.std(axis=0)
    scale[scale == 0] = 1.0
    p, m = p / scale, m / scale
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    if omega is None:
        omega = int(np.sort(np.diff(t))[(len(t) - 1) // 2]) * 10 if len(t) > 1 else 0
    begin = np.searchsorted(t, t - omega)
    if eta is None:
        every = np.sort(np.concatenate([np.zeros(0), *(far(p[begin[i] : i], p[i]) for i in range(1, len(p)))]))
        eta = float(every[int(len(every) * 0.9973)]) if len(every) else np.inf
    if k is None:
        sorted_ = [np.sort(far(m, x)) for x in p]
        reach = lambda n: np.sort(np.concatenate([x[:n] for x in sorted_]))
        k = next((n for n in range(2, 6) if (x := reach(n))[int(len(x) * 0.9)] > eta), min(5, len(m)))
    nearest = lambda x, n: m[np.argsort(far(m, x), kind="stable")[:n]]
    out = np.empty_like(p)
    for i in range(len(p)):
        near = out[begin[i] : i]
        found = np.concatenate([nearest(p[i], k), *(nearest(x, k) for x in near)]) if len(near) else nearest(p[i], 1)
        smooth = (far(found[:, None], near[None]) <= eta).all(axis=1)
        found = found[smooth] if smooth.any() else found
        out[i] = found[far(found, p[i]).argmin()]
    return t, (out * scale)[:, output - 1]
