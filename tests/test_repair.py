"""Repair and quality functions on small series with known results."""

import numpy as np
import pytest

from sparktide.functions import numeric as N
from sparktide.functions import quality as Q
from sparktide.functions import repair as R

SEC = 1_000_000


def test_steps_and_grids():
    t = np.array([0, 10, 20, 31, 40, 60]) * SEC
    assert R.usual_step(t, "mode") == R.usual_step(t) == 10 * SEC
    assert R.usual_step(np.array([0, 1, 2, 3, 103]) * SEC, "cluster") == SEC
    grid, v = R.timestamp_repair(t, np.arange(6.0))
    assert grid.tolist() == (np.arange(7) * 10 * SEC).tolist() and np.array_equal(v, [0, 1, 2, 3, 4, np.nan, 5], equal_nan=True)
    # a point too many between two steps is dropped
    grid, v = R.timestamp_repair(np.array([0, 300, 420, 600, 900]) * SEC, np.arange(5.0), interval=300 * SEC)
    assert grid.tolist() == (np.arange(4) * 300 * SEC).tolist() and v.tolist() == [0, 1, 3, 4]
    assert R.timestamp_repair(t[:2], np.arange(2.0))[0].tolist() == t[:2].tolist()


def test_repair_moves_only_the_outlier():
    t, v = np.arange(20) * SEC, np.arange(20.0)
    v[9] = 60
    for f in (R.screen, R.ls_greedy):
        out = f(t, v)[1]
        assert abs(out[9] - 9) < 1 and np.allclose(np.delete(out, [8, 9, 10]), np.delete(np.arange(20.0), [8, 9, 10]), atol=1)


def test_fills():
    t, v = np.arange(8) * SEC, np.array([0.0, 1, np.nan, 3, 4, np.nan, np.nan, 7])
    assert np.allclose(R.fill_likelihood(t, v)[1], np.arange(8))
    assert np.allclose(R.fill_screen(t, v)[1], np.arange(8))
    assert np.isnan(R.fill_likelihood(t, np.array([np.nan, 1, 2, 3, 4, 5, 6, np.nan]))[1][[0, 7]]).all()
    assert R.fill_ma(t, v)[1].tolist() == [0, 1, 4 / 3, 3, 4, 2, 2, 7]
    with pytest.raises(ValueError, match="another method"):
        R.fill_ar(t, np.array([1.0, 2, 4, 8, np.nan, 30, 60, 120]))


def test_master_data():
    t = np.arange(6) * SEC
    x, y = np.array([1.0, 2, 3, 40, 5, 6]), np.array([1.0, 2, 3, 4, 5, 6])
    out = R.master_repair(t, x, y, master=[(k, k) for k in range(1, 8)], k=3, eta=2.0)[1]
    assert out.tolist()[:3] == [1, 2, 3] and out[3] <= 7
    assert R.master_repair(t, x, y, master=[])[1].tolist() == x.tolist()


def test_time_faults():
    regular = np.arange(30) * SEC
    assert Q.time_faults(regular) == (0, 0, 0)
    assert Q.time_faults(np.delete(regular, [4, 5, 12])) == (3, 0, 0)
    assert Q.time_faults(np.delete(regular, range(10, 20))) == (0, 0, 0)
    assert Q.time_faults(np.delete(regular, range(10, 20)), downtime=False) == (10, 0, 0)
    late = np.sort(np.append(np.delete(regular, 7), 8 * SEC + 200_000))
    assert Q.time_faults(late) == (0, 1, 0)
    assert Q.time_faults(np.sort(np.append(regular, 8 * SEC + 200_000))) == (0, 0, 1)
    assert Q.completeness(regular, np.where(np.arange(30) == 3, np.nan, 1.0), window=15)[1] == [1 - 1 / 15, 1.0]
    assert len(Q.validity(regular, np.arange(30.0), window="10s")[0]) == 0
    assert np.allclose(Q.over_time(regular[:5], np.array([np.nan, 1, np.nan, 3, np.inf])), np.arange(5))


def test_lines():
    rng = np.random.default_rng(0)
    v = np.concatenate([np.arange(20.0), 20 - np.arange(21.0), rng.random(10) * 100])
    begins = N.bottom_up(v, 0.5)
    assert begins[:2] == [0, 20] and N.bottom_up(v[:3], 0.1) == [0] and N.bottom_up(np.zeros(9), 0.1) == [0]
    for error in (0.1, 3.0, 50.0):
        # by definition: the cheapest neighbours first
        parts = [list(range(k, k + 2)) for k in range(0, len(v) - 3, 2)] + [list(range(len(v) - 3, len(v)))]
        while len(parts) > 1:
            costs = [N._error(v[a + b]) for a, b in zip(parts, parts[1:], strict=False)]
            k = int(np.argmin(costs))
            if costs[k] >= error:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert N.bottom_up(v, error) == [p[0] for p in parts]
    assert N.swab(v, 0.5, 60) == begins and N.swab(v, 0.5, 12)[0] == 0
    with pytest.raises(ValueError):
        N.segment(np.arange(4), v[:4], method="top-down")
