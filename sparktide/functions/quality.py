"""Data quality and anomalies of one series, for ``numeric.apply``.

Times are microseconds.  Where other engines differ: a window's values that are not finite are
interpolated over time, and over the ends by the outermost two; a straight stretch keeps its
first point.
"""

from __future__ import annotations

from collections import deque
from itertools import islice

import numpy as np

from ..model import Duration

#: Points that are looked at together when gaps are matched with late points; windows need more rows than that.
LOOKAHEAD = 10
#: Share of the median step up to which a point is too close, from which one is missing, and beyond which the device was off.
CLOSE, GAP, OFF = 0.5, 2.0, 9.0
#: Coefficient of determination of a straight stretch.
STRAIGHT = 0.9999


def over_time(t, v):
    """Values that are not finite on the line between their neighbours; at the ends on that of the outermost two."""
    good = np.flatnonzero(np.isfinite(v))
    if len(good) < 2:
        return np.where(np.isfinite(v), v, v[good[0]] if len(good) else np.nan)
    k = np.clip(np.searchsorted(good, np.arange(len(v))), 1, len(good) - 1)
    a, b = good[k - 1], good[k]
    return np.where(np.isfinite(v), v, v[a] + (v[b] - v[a]) * (t - t[a]) / (t[b] - t[a]))


def deviation(x) -> float:
    """The scaled median distance from the median."""
    return 1.4826 * float(np.nanmedian(np.abs(x - np.nanmedian(x)))) if len(x) else 0.0


def _match(near: list, base: float, lost: int) -> tuple[list, int]:
    """Behind a gap that lost so many points: points too close to the one before are those, late, up to the next gap."""
    kept = near[:2]
    for k, x in enumerate(near[2:], 2):
        step = (x - kept[-1]) / base
        if step >= GAP or len(kept) + lost == k:
            return kept + near[k:], k - len(kept)
        if step > CLOSE:
            kept.append(x)
    return kept, len(near) - len(kept)


def time_faults(t, downtime: bool = True) -> tuple[int, int, int]:
    """How many points are missing, late and redundant.  With ``downtime`` very long gaps are no fault."""
    base = float(np.median(np.diff(t))) if len(t) > 1 else 0.0
    if not base:
        return 0, 0, 0
    rest = iter(t.tolist())
    near, missing, late, redundant = deque(islice(rest, LOOKAHEAD)), 0, 0, 0
    while len(near) > 1:
        step = (near[1] - near[0]) / base
        if step <= CLOSE:
            redundant += 1
            del near[1]
        elif step >= GAP and (not downtime or step <= OFF):
            lost = int(np.floor(step - 0.5))
            kept, found = _match(list(near), base, lost)
            near, late, missing = deque(kept), late + found, missing + lost - found
        near.popleft()
        near.extend(islice(rest, LOOKAHEAD - len(near)))
    return missing, late, redundant


def _windows(t, v, window):
    """Parts of the series: all of it, so many rows each, or so much time each from the first point on."""
    if window is None:
        return [(t, v)]
    if isinstance(window, str) and not window.isdigit():
        place = (t - t[0]) // Duration(window).micros if len(t) else t
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(t) else []
    else:
        edges = np.arange(0, len(v), int(window))
    return [(t[a:b], v[a:b]) for a, b in zip(edges, [*edges[1:], len(v)], strict=True)]


def _scored(t, v, window, score):
    parts = [(a[0], score(a, x)) for a, x in _windows(t, v, window) if len(x) > LOOKAHEAD]
    return [a for a, _ in parts], [b for _, b in parts]


def completeness(t, v, window=None, downtime=True):
    """1 less the share of missing points and of values that are not finite."""

    def score(a, x):
        missing = time_faults(a, downtime)[0]
        return 1 - (missing + int((~np.isfinite(x)).sum())) / (len(x) + missing)

    return _scored(t, v, window, score)


def consistency(t, v, window=None):
    """1 less the share of redundant points."""
    return _scored(t, v, window, lambda a, x: 1 - time_faults(a)[2] / len(x))


def timeliness(t, v, window=None):
    """1 less the share of late points, which stand close behind a gap."""
    return _scored(t, v, window, lambda a, x: 1 - time_faults(a)[1] / len(x))


def validity(t, v, window=None):
    """1 less a quarter of the shares of values, changes, speeds and changes of speed that lie beyond three deviations."""
    beyond = lambda x: int((np.abs(x - np.median(x)) > 3 * deviation(x)).sum()) if len(x) else 0

    def score(a, x):
        x = over_time(a, x)
        speed = np.diff(x) / np.diff(a)
        return 1 - 0.25 * (beyond(x) + beyond(np.diff(x)) + beyond(speed) + beyond(np.diff(speed))) / len(x)

    return _scored(t, v, window, score)


def two_sided_filter(t, v, length=5, threshold=0.4):
    """Points near the sum of their ``length`` neighbours on either side, divided by ``length``; others are dropped.

    Neighbours count up to ``length`` seconds away; the distance is relative to the larger of the
    two, plus one, and one near side is enough.
    """
    sides = []
    for ahead in (False, True):
        total = np.zeros(len(v))
        reach = range(1, min(length, len(v) - 1) + 1)
        # from the earliest to the latest, as sums depend on their order
        for k in reach if ahead else reversed(reach):
            near = t[k:] - t[:-k] <= length * 1_000_000
            if ahead:
                total[:-k] += np.where(near, v[k:], 0)
            else:
                total[k:] += np.where(near, v[:-k], 0)
        sides.append(total / length)
    keep = np.zeros(len(v), bool)
    for mean in sides:
        keep |= np.abs(mean - v) / (np.maximum(mean, v) + 1) < threshold
    return t[keep], v[keep]


class _Line:
    """Least squares over points that come one by one, and may be taken back."""

    def __init__(self, x, y):
        self.n, self.x, self.y, self.xx, self.xy, self.yy = 0, 0.0, 0.0, 0.0, 0.0, 0.0
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            self.add(a, b)

    def add(self, x, y, sign=1):
        self.n += sign
        if not self.n:
            return
        dx, dy = x - self.x, y - self.y
        weight = (self.n - sign) / self.n * sign
        self.xx, self.xy, self.yy = self.xx + dx * dx * weight, self.xy + dx * dy * weight, self.yy + dy * dy * weight
        self.x, self.y = self.x + sign * dx / self.n, self.y + sign * dy / self.n

    def straight(self) -> bool:
        """Level lines count."""
        return self.yy == 0 or (self.xx > 0 and self.xy * self.xy >= STRAIGHT * self.xx * self.yy)


def missing_stretches(t, v, minlen=10):
    """1 for points of straight stretches longer than ``minlen``, which stand for missing data, else 0.

    Half-windows of ``minlen // 2`` points are tried one after the other; a straight one is
    extended back into the half before it, and forward for as long as the line holds.
    """
    n, half, flags = len(v), max(2, minlen // 2), np.zeros(len(v))
    x = (t - t[0]).astype(float) if n else t
    at, first_look = 0, True
    while at < n:
        begin = at if first_look else at + half
        if begin + half > n:
            break
        line = _Line(x[begin : begin + half], v[begin : begin + half])
        if not line.straight():
            at, first_look = (at, False) if first_look else (at + half, False)
            continue
        level = v[begin] if line.yy == 0 else None
        holds = lambda k, line=line, level=level: v[k] == level if level is not None else line.straight()
        first = begin
        while first > at:
            line.add(x[first - 1], v[first - 1])
            if not holds(first - 1):
                line.add(x[first - 1], v[first - 1], -1)
                break
            first -= 1
        end = begin + half
        while end < n:
            line.add(x[end], v[end])
            if not holds(end):
                break
            end += 1
        if end - first > minlen:
            flags[first:end] = 1
        at, first_look = end, True
    return t, flags
