import numpy as np
import pytest

from sparktide.functions import repair, series


@pytest.mark.parametrize("method", ["spline", "knn"])
def test_unknown_fills_raise(method):
    with pytest.raises(ValueError, match=method):
        series.value_fill(None, "x", ["k"], method=method)


def test_unknown_repair_raises():
    with pytest.raises(ValueError, match="nearest"):
        repair.timestamp_repair(np.arange(4), np.zeros(4), method="nearest")
