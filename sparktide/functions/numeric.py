"""Functions that follow a whole series in numpy, one series per group.

``apply`` runs them with ``applyInPandas``; a series must fit in a task's memory, and many
series run side by side.  Each function takes times, values (float arrays without nulls, in the
order of time; NaN allowed where it says so) and parameters, and returns (times, values).
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply(df: DataFrame, function, value: str | list[str], by: list[str], time: str = "time", **parameters) -> DataFrame:
    """(by, time, value) of ``function`` for each series; null rows are left out first."""
    columns = [value] if isinstance(value, str) else value
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "time long", "value double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        t, v = function(pdf[time].to_numpy(np.int64), *[pdf[c].to_numpy(np.float64) for c in columns], **parameters)
        out = pd.DataFrame({"time": np.asarray(t, np.int64), "value": np.asarray(v, np.float64)})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0] if len(pdf) else None)
        return out

    there = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return df.select(*by, time, *columns).where(there).groupBy(*by).applyInPandas(run, schema)


def _index(values):
    return np.arange(len(values)), values


# profiling


def acf(t, v):
    """Cross-correlation of the series with itself, as ``xcorr``."""
    return xcorr(t, v, v)


def xcorr(t, a, b):
    """All shifts: the first half divided by the overlap, the second by the length less the shift."""
    n = len(a)
    full = np.correlate(np.nan_to_num(a), np.nan_to_num(b), "full")
    return np.arange(1, 2 * n), full / np.concatenate([np.arange(1, n + 1), np.arange(n - 1, 0, -1)]) if n else full[:0]


def _autocorrelation(v, lags):
    d = v - v.mean()
    c0 = (d * d).sum()
    return np.array([1.0, *[(d[k:] * d[:-k]).sum() / c0 if c0 else 0.0 for k in range(1, lags + 1)]])


def _levinson(r, p):
    """Coefficients of an autoregression, and the partial correlations on the way."""
    phi, error, partial = np.zeros(0), r[0], []
    for k in range(1, p + 1):
        kappa = (r[k] - (phi * r[k - 1 : 0 : -1]).sum()) / error if error else 0.0
        phi = np.append(phi - kappa * phi[::-1], kappa)
        error *= 1 - kappa * kappa
        partial.append(kappa)
    return phi, np.array(partial)


def pacf(t, v, lag=None):
    """Partial autocorrelations at the times of the first rows, from autocovariances divided by their overlap."""
    n, v = len(v), np.where(np.isfinite(v), v, 0.0)
    if n < 2:
        return t[:0], v[:0]
    if lag is None or not 0 <= lag < n:
        lag = min(int(10 * math.log10(n)), n - 1)
    d = v - v.mean()
    r = np.array([(d[k:] * d[: n - k]).sum() / (n - k) for k in range(lag + 1)])
    return t[: lag + 1], np.append(1.0, _levinson(r, lag)[1])


def ar(t, v, p=1):
    """Levinson-Durbin coefficients at 1..p; NaN is filled by lines before."""
    v = _lines(v)
    return np.arange(1, p + 1), _levinson(_autocorrelation(v, p), p)[0]


def _lines(v):
    good = ~np.isnan(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(good), v[good]) if good.any() else v


def period(t, v):
    """The median step between peaks of the correlation of the series with itself, 0 without any.

    The correlation at a shift is that of the overlapping parts.  The first peak above one half
    says how wide the window is in which a peak must be the largest value.
    """
    good = np.isfinite(v)
    if not good.any():
        return [0], [0.0]
    # values that are not finite repeat the one before
    v = v[np.maximum.accumulate(np.where(good, np.arange(len(v)), int(good.argmax())))]
    n = len(v)
    total, power = (np.concatenate([[0], np.cumsum(x)]) for x in (v, v * v))
    k = np.arange(n)
    size = n - k
    xy = np.correlate(v, v, "full")[n - 1 :]
    x, y, xx, yy = total[size], total[n] - total[k], power[size], power[n] - power[k]
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (size * xy - x * y) / np.sqrt(size * xx - x * x) / np.sqrt(size * yy - y * y)
    inner = np.arange(1, min(n - 1, 100))
    tops = inner[(r[inner] > r[inner - 1]) & (r[inner] > r[inner + 1]) & (r[inner] > 0.5)]
    window = int(tops[0]) if len(tops) else 100
    peaks = [0]
    for i in range(n - window + 1):
        middle = i + window // 2
        part = np.nan_to_num(r[i : i + window], nan=-np.inf)
        if r[middle] > 0.5 and part.argmax() == window // 2:
            peaks.append(middle)
    return [0], [float(int(np.median(np.diff(peaks)))) if len(peaks) > 1 else 0.0]


def _gamma_q(a, x):
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - lead * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def qlb(t, v, lag=None):
    """Ljung-Box p-values for 1..lag."""
    n = len(v)
    lag = lag if lag else n - 2
    if lag < 1:
        return _index(np.zeros(0))
    r = _autocorrelation(v, lag)[1:]
    q = n * (n + 2) * np.cumsum(r * r / (n - np.arange(1, lag + 1)))
    return np.arange(1, lag + 1), [_gamma_q(k / 2, x / 2) for k, x in enumerate(q, 1)]


def sample_triangle(t, v, k=1):
    """Largest triangles of three buckets: the first and last point, and one of each bucket between."""
    n = len(v)
    if k >= n or k < 3:
        return t[:k] if k < n else t, v[:k] if k < n else v
    edges = np.floor(np.arange(k - 1) * (n - 2) / (k - 2)).astype(int) + 1
    out, at = [0], 0
    for i in range(k - 2):
        lo, hi = edges[i], edges[i + 1]
        nxt = slice(hi, edges[i + 2] if i + 2 < len(edges) else n)
        tx, vx = t[nxt].mean(), v[nxt].mean()
        area = np.abs((t[at] - tx) * (v[lo:hi] - v[at]) - (t[at] - t[lo:hi]) * (vx - v[at]))
        at = lo + int(area.argmax())
        out.append(at)
    out.append(n - 1)
    return t[out], v[out]


def _line(v):
    """Values of the line of least squares over row numbers."""
    n = len(v)
    if n < 3:
        return v
    x = np.arange(n) - (n - 1) / 2
    return v.mean() + (x * v).sum() / (x * x).sum() * x


def _error(v):
    return float(np.abs(_line(v) - v).mean())


def bottom_up(v, error: float) -> list[int]:
    """Where the pieces of lines begin: the neighbours whose joint line errs least are joined while it errs less than ``error`` on average."""
    n = len(v)
    if n <= 3:
        return [0]
    # pairs; a last one of three if the number is odd
    end = {a: min(a + 2, n) for a in range(0, n - n % 2, 2)}
    end[max(end)] = n
    left = {b: a for a, b in end.items()}
    cost = {a: _error(v[a : end[b]]) for a, b in end.items() if b < n}
    heap = [(c, a) for a, c in cost.items()]
    heapq.heapify(heap)
    while heap and heap[0][0] < error:
        c, a = heapq.heappop(heap)
        if cost.get(a) != c:
            continue
        b = end[a]
        end[a] = end.pop(b)
        cost.pop(b, None)
        left[end[a]] = a
        left.pop(b)
        for p in (a, left.get(a)):
            if p is not None and end[p] < n:
                cost[p] = _error(v[p : end[end[p]]])
                heapq.heappush(heap, (cost[p], p))
            elif p is not None:
                cost.pop(p, None)
    return sorted(end)


def swab(v, error: float, window: int) -> list[int]:
    """The same over a window that slides: its first piece is final, then the window moves on behind it."""
    begins, at, n = [], 0, len(v)
    while at < n:
        found = bottom_up(v[at : at + max(window, 4)], error)
        if at + max(window, 4) >= n:
            return begins + [at + a for a in found]
        begins.append(at)
        at += found[1] if len(found) > 1 else max(window, 4)
    return begins


def segment(t, v, error=0.1, output="first", method="bottom-up", window=10):
    """Pieces of lines: their first points (``first``) or all points on them (``all``)."""
    if method.lower() not in ("bottom-up", "swab"):
        raise ValueError(f"no such method of segmentation: {method}")
    good = np.isfinite(v)
    t, v = t[good], v[good]
    if not len(v):
        return t, v
    begins = bottom_up(v, error) if method.lower() == "bottom-up" else swab(v, error, window)
    lines = np.concatenate([_line(v[a:b]) for a, b in zip(begins, [*begins[1:], len(v)], strict=True)])
    return (t[begins], lines[begins]) if output == "first" else (t, lines)


def spline(t, v, points=10):
    """Akima's spline at evenly spaced times, rounded to whole microseconds; nothing for fewer than five points."""
    good = np.isfinite(v)
    t, v = t[good], v[good]
    n = len(v)
    if n < 5 or points < 2:
        return _index(np.zeros(0))
    x = (t - t[0]).astype(float)
    d = np.diff(v) / np.diff(x)
    w = np.abs(np.diff(d))
    slope = np.empty(n)
    i = np.arange(2, n - 2)
    ahead, back = w[i], w[i - 2]
    even = ((x[i + 1] - x[i]) * d[i - 1] + (x[i] - x[i - 1]) * d[i]) / (x[i + 1] - x[i - 1])
    flat = (np.abs(ahead) < 1e-300) & (np.abs(back) < 1e-300)
    slope[i] = np.where(flat, even, (ahead * d[i - 1] + back * d[i]) / np.where(flat, 1, ahead + back))
    # the outer two slopes on either side are those of the parabola through the outer three points
    for a, places in ((0, (0, 1)), (n - 3, (n - 2, n - 1))):
        curve = (d[a + 1] - d[a]) / (x[a + 2] - x[a])
        for k in places:
            slope[k] = d[a] + curve * (2 * x[k] - x[a] - x[a + 1])
    k = np.arange(points)
    at = np.floor((x[0] * (points - 1 - k) + x[-1] * k) / (points - 1) + 0.5)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    h = x[k + 1] - x[k]
    u = (at - x[k]) / h
    y = v[k] * (1 + 2 * u) * (1 - u) ** 2 + v[k + 1] * u * u * (3 - 2 * u) + h * u * (1 - u) * (slope[k] * (1 - u) - slope[k + 1] * u)
    return t[0] + at.astype(np.int64), y


# anomalies


def lof(t, *columns, k=3):
    """Local outlier factors of the rows as points."""
    p = np.column_stack(columns)
    n = len(p)
    if n <= k:
        return t, np.zeros(n)
    near, dist = np.empty((n, k), int), np.empty((n, k))
    for i in range(0, n, 256):
        d = np.sqrt(((p[i : i + 256, None] - p[None]) ** 2).sum(-1))
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        o = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[i : i + 256], dist[i : i + 256] = o, np.take_along_axis(d, o, 1)
    reach = np.maximum(dist, dist[near, k - 1])
    density = k / np.maximum(reach.sum(1), 1e-300)
    return t, density[near].mean(1) / density


def lof_series(t, v, k=3, window=5):
    """Factors of the subsequences of ``window`` values, at their first times."""
    sub = np.lib.stride_tricks.sliding_window_view(v, window) if len(v) >= window else np.zeros((0, window))
    return lof(t[: len(sub)], *sub.T, k=k) if len(sub) else _index(np.zeros(0))


def outlier(t, v, k=3, r=5.0, w=1000, s=500):
    """Points with fewer than k others within r, in windows of w rows every s; the last full window needs a row after it."""
    found = set()
    for a in range(0, len(v) - w, s):
        part = v[a : a + w]
        order = np.sort(part[~np.isnan(part)])
        # each is near from above or below, or both
        n = _up_to(order, part, r) + _up_to(-order[::-1], -part, r) - len(order) - 1
        found |= set((a + np.flatnonzero(n < k)).tolist())
    at = sorted(found)
    return t[at], v[at]


def _up_to(order, x, r):
    """For each x how many of ``order``, which ascends, have ``o - x <= r``; the difference decides, for ``x + r`` rounds otherwise."""
    at, ends = np.searchsorted(order, x + r, "right"), np.concatenate([[-np.inf], order, [np.inf]])
    wrong = np.flatnonzero((ends[at] - x > r) | (ends[at + 1] - x <= r))
    low, high = np.zeros(len(wrong), np.int64), np.full(len(wrong), len(order))
    while (low < high).any():
        mid = (low + high) // 2
        near = (low < high) & (ends[mid + 1] - x[wrong] <= r)
        low, high = np.where(near, mid + 1, low), np.where(near, high, mid)
    at[wrong] = low
    return at


# matching


def dtw(t, a, b):
    """Least sum of distances over monotone alignments, by anti-diagonals."""
    n, m = len(a), len(b)
    if not n or not m:
        return [0], [0.0]
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    last[0] = np.inf
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        cost = np.abs(a[i] - b[d - i])
        now = np.full(n + 1, np.inf)
        best = np.minimum(np.minimum(last[i], last[i + 1]), before[i])
        now[i + 1] = cost + (np.where(i + (d - i) == 0, 0.0, best))
        before, last = last, now
    return [0], [float(last[n])]


def ptnsym(t, v, window=10, threshold=math.inf, mirrored=False):
    """How far each window is from being symmetric, at its first time; up to ``threshold``.

    The distance that other engines give compares the ends of the window only.  With
    ``mirrored`` it is the sum of squared differences along the best alignment of the window
    with its mirror image, from the ends to the middle.
    """
    if len(v) < window:
        return t[:0], v[:0]
    parts = np.lib.stride_tricks.sliding_window_view(v, window)
    if not mirrored:
        score = (parts[:, 0] - parts[:, -1]) ** 2 if window > 1 else np.zeros(len(parts))
    else:
        # by length of the inner part: it costs its ends' difference and the best of the parts inside it
        shorter, short = np.zeros((len(parts), window + 1)), np.zeros((len(parts), window))
        for size in range(2, window + 1):
            ends = (parts[:, : window - size + 1] - parts[:, size - 1 :]) ** 2
            now = ends + np.minimum(np.minimum(short[:, 1 : window - size + 2], short[:, : window - size + 1]), shorter[:, 1 : window - size + 2])
            shorter, short = short, now
        score = short[:, 0]
    keep = score <= threshold
    return t[: len(parts)][keep], score[keep]


# frequency


def conv(t, a, b):
    return _index(np.convolve(a, b)) if len(a) and len(b) else _index(np.zeros(0))


def deconv(t, a, b, result="quotient"):
    """Division of polynomials, highest power last; zeros at the end of ``a`` are coefficients like any other."""
    a, b = a[np.isfinite(a)], np.trim_zeros(b[np.isfinite(b)], "b")
    if not len(b):
        raise ZeroDivisionError("deconv by zero")
    quotient, m = result.startswith("quoti"), len(b) - 1
    if m >= len(a):
        return _index(np.zeros(1) if quotient else a)
    q, rest = np.zeros(len(a) - m), a.astype(float)
    for i in range(len(q) - 1, -1, -1):
        q[i] = rest[i + m] / b[m]
        rest[i + m] = 0
        rest[i : i + m] -= q[i] * b[:m]
    return _index(q if quotient else rest)


#: Scaling coefficients of orthogonal wavelets (fixed values).
WAVELETS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.7071067811865476, 0.7071067811865476],
    "db4": [0.48296291314469025, 0.8365163037378079, 0.22414386804185735, -0.12940952255092145],
    "db6": [0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656],
    "db8": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}


def _wavelet(method, coef):
    h = np.array([float(x) for x in coef.split(",")] if coef else WAVELETS[method.lower()])
    return h, h[::-1] * np.where(np.arange(len(h)) % 2, -1, 1)


def _power_of_two(n):
    if n & (n - 1) or not n:
        raise ValueError("the length must be a power of two")


def dwt(t, v, method="haar", coef=None, layer=1):
    """Smooth parts first, then details, ``layer`` times; the series is periodic."""
    _power_of_two(len(v))
    h, g = _wavelet(method, coef)
    out, n = v.copy(), len(v)
    for _ in range(layer):
        if n < 2:
            break
        at = (np.arange(0, n, 2)[:, None] + np.arange(len(h))) % n
        out[:n] = np.concatenate([out[at] @ h, out[at] @ g])
        n //= 2
    return _index(out)


def idwt(t, v, method="haar", coef=None, layer=1):
    _power_of_two(len(v))
    h, g = _wavelet(method, coef)
    out = v.copy()
    sizes = [len(v) >> k for k in range(layer) if len(v) >> k >= 2]
    for n in reversed(sizes):
        at = (np.arange(0, n, 2)[:, None] + np.arange(len(h))) % n
        back = np.zeros(n)
        np.add.at(back, at, out[: n // 2, None] * h + out[n // 2 : n, None] * g)
        out[:n] = back
    return _index(out)


def fft(t, v, result="abs", compress=1.0):
    """Real part, imaginary part, size or angle of each bin.

    ``compress`` below 1 gives the lowest bins until they and their mirror images hold more than
    that share of the energy, and the last bin.
    """
    f = np.fft.fft(v)
    at = np.arange(len(f))
    if compress < 1 and len(f):
        n, energy = len(f), np.abs(f) ** 2
        inner = energy[0] + 2 * np.cumsum(energy[1 : n // 2 + 1])
        last = min(int(np.searchsorted(inner, compress * energy.sum(), side="right")) + 1, n // 2)
        at = np.append(np.arange(last + 1), n - 1)
    f = f[at]
    return at, {"real": f.real, "imag": f.imag, "abs": np.abs(f), "angle": np.angle(f)}[result]


def ifft(t, re, im, interval=1_000_000, start=0):
    return start + np.arange(len(re)) * interval, np.fft.ifft(re + 1j * im).real


def lowpass(t, v, wpass=0.5):
    n = len(v)
    f = np.fft.fft(v)
    edge = math.ceil(wpass * n / 2)
    f[edge : n - edge + 1] = 0
    return t, np.fft.ifft(f).real


def highpass(t, v, wpass=0.5):
    n = len(v)
    f = np.fft.fft(v)
    edge = math.floor(wpass * n / 2)
    f[: edge + 1] = 0
    if edge:
        f[n - edge :] = 0
    return t, np.fft.ifft(f).real


def swing_door(t, v, deviation=1.0):
    """Points that a line between kept ones would miss by more than ``deviation``."""
    if len(v) < 3:
        return t, v
    keep, a, up, down = [0], 0, -math.inf, math.inf
    for i in range(1, len(v)):
        dt = t[i] - t[a]
        up, down = max(up, (v[i] - v[a] - deviation) / dt), min(down, (v[i] - v[a] + deviation) / dt)
        if up > down:
            a = i - 1
            keep.append(a)
            dt = t[i] - t[a]
            up, down = (v[i] - v[a] - deviation) / dt, (v[i] - v[a] + deviation) / dt
    keep.append(len(v) - 1)
    return t[keep], v[keep]


def down_sample(t, v, interval=1):
    """A point is kept if it is at least ``interval`` after the one kept last."""
    keep, last = [], None
    for i, x in enumerate(t.tolist()):
        if last is None or x - last >= interval:
            keep.append(i)
            last = x
    return t[keep], v[keep]
