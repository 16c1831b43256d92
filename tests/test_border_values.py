"""Queries against their SQL on events whose values lie on a border of the function."""

import duckdb
import numpy as np
import pytest
from oracle import differences

from sparktide.functions import numeric as N
from sparktide.plans.queries import ORACLE, QUERIES


def against_sql(spark, folder, name, *series):
    """Differences of a query from its SQL on events of these values, one user for each series."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(i, user, x) for user, values in enumerate(series) for i, x in enumerate(values)]
    con.executemany("INSERT INTO events SELECT ?, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ?, ?, 'view', ?, '{}'", [(k, i, user, x) for k, (i, user, x) in enumerate(rows)])
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return differences(spark, QUERIES[name], ORACLE[name], folder, con)


def test_deconv_keeps_zeros_at_the_end(spark, tmp_path):
    assert against_sql(spark, tmp_path, "deconv", [3.0, 0.5, 0.0], [0.0, 0.0], [1.0, 2.0]) == []
    a, b = np.array([4.0, 13.0, 0.0, 0.0]), np.array([4.0, 5.0, 0.0])
    q, rest = (N.deconv(None, a, b, result)[1] for result in ("quotient", "remainder"))
    assert len(q) == 3 and np.allclose(np.convolve(q, b[:2]) + rest, a)
    assert N.deconv(None, a[:1], b)[1].tolist() == [0.0] and N.deconv(None, a[:1], b, "remainder")[1].tolist() == [4.0]
    with pytest.raises(ZeroDivisionError):
        N.deconv(None, a, np.zeros(2))


def test_outlier_counts_points_at_the_distance(spark, tmp_path):
    # 5.69 - 0.69 is 5 at most, though 0.69 + 5 is less than 5.69, and 5.03 - 0.03, though 5.03 - 5 is more; 8.05 - 3.05 is more than 5, though 3.05 + 5 is 8.05
    far = [1000.0 * k for k in range(1, 20)]
    near = [[0.69, 5.69, 5.69, 5.69], [5.03, 0.03, 0.03, 0.03], [3.05, 8.05, 8.05, 8.05]]
    assert against_sql(spark, tmp_path, "outlier", *[(x + far)[:21] for x in near]) == []
    rng = np.random.default_rng(0)
    for w in (1, 2, 30, 200):
        v = rng.integers(0, 3000, 200 + w) / 100
        at = {a + i for a in range(0, len(v) - w, 7) for i in range(w) if (np.abs(v[a : a + w] - v[a + i]) <= 5).sum() - 1 < w // 3}
        assert N.outlier(np.arange(len(v)), v, k=w // 3, r=5.0, w=w, s=7)[0].tolist() == sorted(at)


def test_two_sided_filter_sums_in_the_order_of_time(spark, tmp_path):
    # the five values before the sixth have a mean 0.4 of it away, more or less by the last bit
    before = [[62.9, 2.24, 60.97, 79.47, 82.22, 96.6, 67.84, 70.35, 26.14, 1.01, 47.89], [11.21, 2.39, 37.35, 7.12, 123.2, 61.09, 3.33, 39.7, 17.83, 63.5, 6.16]]
    assert against_sql(spark, tmp_path, "two_sided_filter", *before) == []


def test_missing_stretches_end_where_the_line_does(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise = [rng.integers(0, 10_000, 60) / 100 for _ in range(3)]
    # values that continue the line i, before and behind it
    noise[0][45], noise[1][19], noise[2][18:20], noise[2][45:47] = 46.2, 20.0, [19, 20], [46, 47]
    assert against_sql(spark, tmp_path, "missing_stretches", *[x.tolist() for x in noise]) == []
