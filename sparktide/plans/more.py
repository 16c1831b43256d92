"""Queries of numeric functions, schedules, user functions and the SQL dialect, with the same results in DuckDB.

Functions that follow a series step by step get inputs whose result is known in closed form.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import quality as Q
from ..functions import repair as R
from ..functions import scalar as SC
from ..functions import series as SE
from ..functions import user
from ..model import column_or_null, micros, to_long
from ..operators import fill as FI
from ..operators import shape as SH
from ..operators import windows as W
from ..sources import store
from ..sql import Database
from ..streaming.schedule import ContinuousQuery
from .queries import CONS, DAILY, DAY, DN, EV, GRID, HOUR, MONTHS, QUERIES, E, S, _grid, _months, daily, events, query, rounded, table

U, T = ["user_id"], ["event_type"]
NAN = float("nan")
SEC = f"WITH {EV}, s AS (SELECT user_id, time AS t, value, v, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)"


def seconds(spark, d) -> DataFrame:
    """Each user's events as a regular series: event i at second i."""
    i = F.row_number().over(Window.partitionBy(*U).orderBy("time"))
    return events(spark, d).select(*U, "value", i.alias("i")).withColumn("time", F.col("i").cast("long") * 1_000_000)


def holes(spark, d) -> DataFrame:
    """``seconds`` with NaN at every sixth event, from the third on."""
    return seconds(spark, d).withColumn("x", F.when(F.col("i") % 6 == 3, NAN).otherwise(F.col("value")))


def known(df: DataFrame) -> DataFrame:
    """Points that have a value; NaN comes back from Python as null."""
    return df.where(F.col("value").isNotNull() & ~F.isnan("value"))


# anomalies


@query(f"""{SEC}, w AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) / 5 AS b, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) / 5 AS a FROM s)
SELECT user_id, i * 1000000 AS time, round(value, 6) AS value FROM w WHERE abs(b - value) / (greatest(b, value) + 1) < 0.4 OR abs(a - value) / (greatest(a, value) + 1) < 0.4""")
def two_sided_filter(spark, d):
    return rounded(N.apply(seconds(spark, d), Q.two_sided_filter, "value", U), "value", n=6)


@query(f"{SEC} SELECT user_id, i * 1000000 AS time, (i BETWEEN 21 AND 45)::INT::DOUBLE AS value FROM s")
def missing_stretches(spark, d):
    """The line leaves the range of the user's values: a value that continues it by chance would belong to the stretch."""
    steep = F.col("i") * (F.max(F.abs("value")).over(Window.partitionBy(*U)) + 1)
    line = F.when(F.col("i").between(21, 45), steep).otherwise(F.col("value"))
    return N.apply(seconds(spark, d).withColumn("x", line), Q.missing_stretches, "x", U)


@query(f"""{SEC}, d AS (SELECT a.user_id, a.i, b.i AS j, abs(a.value - b.value) AS d FROM s a JOIN s b ON a.user_id = b.user_id AND a.i <> b.i),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY d, j) <= 3), m AS (SELECT user_id, i, max(d) AS r FROM k GROUP BY ALL),
l AS (SELECT k.user_id, k.i, 3 / sum(greatest(k.d, m.r)) AS l FROM k JOIN m ON m.user_id = k.user_id AND m.i = k.j GROUP BY ALL),
f AS (SELECT k.user_id, k.i, avg(o.l) / any_value(p.l) AS f FROM k JOIN l o ON o.user_id = k.user_id AND o.i = k.j JOIN l p ON p.user_id = k.user_id AND p.i = k.i GROUP BY ALL)
SELECT user_id, t AS time, round(f, 4) AS value FROM f JOIN s USING (user_id, i)""")
def lof_events(spark, d):
    return rounded(N.apply(events(spark, d), N.lof, "value", U), "value")


@query(f"""{SEC}, w AS (SELECT user_id, a, n, unnest(range(a, a + 20)) + 1 AS i FROM (SELECT DISTINCT user_id, n, unnest(range(0, n, 10)) AS a FROM s) WHERE a + 20 < n),
p AS (SELECT w.user_id, w.a, w.i, s.value, s.t FROM w JOIN s USING (user_id, i)), c AS (SELECT x.user_id, x.a, x.i, x.t, x.value, count(*) - 1 AS near FROM p x JOIN p y ON x.user_id = y.user_id AND x.a = y.a AND abs(x.value - y.value) <= 5 GROUP BY ALL)
SELECT DISTINCT user_id, t AS time, round(value, 6) AS value FROM c WHERE near < 3""")
def outlier(spark, d):
    return rounded(N.apply(events(spark, d), N.outlier, "value", U, k=3, r=5.0, w=20, s=10), "value", n=6)


# quality


def _days(spark, d):
    return daily(spark, d).withColumn("k", ((F.col("time") - S) / DAY).cast("int"))


@query(f"WITH {EV}, {DAILY}, p AS (SELECT event_type, time, time - lag(time) OVER (PARTITION BY event_type ORDER BY time) AS g FROM daily WHERE (time - {S}) // {DAY} % 7 <> 3) SELECT event_type, min(time) AS time, round(1 - sum(CASE WHEN g >= {2 * DAY} THEN g // {DAY} - 1 ELSE 0 END) / (count(*) + sum(CASE WHEN g >= {2 * DAY} THEN g // {DAY} - 1 ELSE 0 END)), 6) AS value FROM p GROUP BY event_type")
def completeness(spark, d):
    """Every seventh day is missing."""
    return rounded(N.apply(_days(spark, d).where("k % 7 <> 3"), Q.completeness, "value", T), "value", n=6)


@query(f"WITH {EV}, {DAILY} SELECT event_type, min(time) AS time, round(1 - count(*) FILTER ((time - {S}) // {DAY} % 5 = 1) / (count(*) + count(*) FILTER ((time - {S}) // {DAY} % 5 = 1)), 6) AS value FROM daily GROUP BY event_type")
def consistency(spark, d):
    """Every fifth day has a second point, two hours later."""
    x = _days(spark, d)
    both = x.unionByName(x.where("k % 5 = 1").withColumn("time", F.col("time") + 2 * HOUR))
    return rounded(N.apply(both, Q.consistency, "value", T), "value", n=6)


@query(f"WITH {EV}, {DAILY} SELECT event_type, min(time) AS time, round(1 - count(*) FILTER ((time - {S}) // {DAY} % 7 = 3) / count(*), 6) AS value FROM daily GROUP BY event_type")
def timeliness(spark, d):
    """Every seventh day's point comes two hours behind that of the day after."""
    late = F.when(F.col("k") % 7 == 3, F.col("time") + DAY + 2 * HOUR).otherwise(F.col("time"))
    return rounded(N.apply(_days(spark, d).withColumn("time", late), Q.timeliness, "value", T), "value", n=6)


def _beyond(name: str, rows: str) -> str:
    return f"{name}m AS (SELECT user_id, median({rows}) AS m FROM x GROUP BY 1), {name}d AS (SELECT user_id, any_value(m) AS m, 1.4826 * median(abs({rows} - m)) AS s FROM x JOIN {name}m USING (user_id) GROUP BY 1), {name} AS (SELECT user_id, count(*) FILTER (abs({rows} - m) > 3 * s) AS n FROM x JOIN {name}d USING (user_id) GROUP BY 1)"


@query(f"""{SEC}, y AS (SELECT *, value - lag(value) OVER o AS b, (value - lag(value) OVER o) / (t - lag(t) OVER o) AS c FROM s WINDOW o AS (PARTITION BY user_id ORDER BY i)), x AS (SELECT *, c - lag(c) OVER (PARTITION BY user_id ORDER BY i) AS e FROM y),
{_beyond("pa", "value")}, {_beyond("pb", "b")}, {_beyond("pc", "c")}, {_beyond("pe", "e")}, f AS (SELECT user_id, min(t) AS time, count(*) AS n FROM s GROUP BY 1)
SELECT user_id, time, round(1 - 0.25 * (pa.n + pb.n + pc.n + pe.n) / f.n, 6) AS value FROM f JOIN pa USING (user_id) JOIN pb USING (user_id) JOIN pc USING (user_id) JOIN pe USING (user_id)""")
def validity(spark, d):
    return rounded(N.apply(events(spark, d), Q.validity, "value", U), "value", n=6)


# profiling


COV = "m AS (SELECT user_id, avg(value) AS m FROM s GROUP BY 1), x AS (SELECT s.user_id, s.i, s.n, s.t, value - m AS d FROM s JOIN m USING (user_id)), y AS (SELECT *, lead(d) OVER o AS d1, lead(d, 2) OVER o AS d2, lead(d, 3) OVER o AS d3, lead(d, 4) OVER o AS d4 FROM x WINDOW o AS (PARTITION BY user_id ORDER BY i))"


@query(f"""{SEC}, {COV}, r AS (SELECT user_id, avg(d * d) AS r0, avg(d * d1) AS r1, avg(d * d2) AS r2 FROM y GROUP BY 1)
SELECT user_id, t AS time, round(CASE i WHEN 1 THEN 1 WHEN 2 THEN r1 / r0 ELSE (r2 * r0 - r1 * r1) / (r0 * r0 - r1 * r1) END, 6) AS value FROM s JOIN r USING (user_id) WHERE i <= 3""")
def pacf(spark, d):
    return rounded(N.apply(events(spark, d), N.pacf, "value", U, lag=2), "value", n=6)


@query(f"{SEC}, {COV} SELECT user_id, 1::BIGINT AS time, round(sum(d * d1) / sum(d * d), 6) AS value FROM y GROUP BY 1")
def ar(spark, d):
    return rounded(N.apply(events(spark, d), N.ar, "value", U, p=1), "value", n=6)


@query(f"""{SEC}, {COV}, r AS (SELECT user_id, any_value(n) AS n, sum(d * d1) / sum(d * d) AS a, sum(d * d2) / sum(d * d) AS b, sum(d * d3) / sum(d * d) AS c, sum(d * d4) / sum(d * d) AS e FROM y GROUP BY 1),
q AS (SELECT user_id, n * (n + 2) * (a * a / (n - 1) + b * b / (n - 2)) / 2 AS q2, n * (n + 2) * (a * a / (n - 1) + b * b / (n - 2) + c * c / (n - 3) + e * e / (n - 4)) / 2 AS q4 FROM r)
SELECT user_id, 2::BIGINT AS time, round(exp(-q2), 6) AS value FROM q UNION ALL SELECT user_id, 4, round(exp(-q4) * (1 + q4), 6) FROM q""")
def qlb(spark, d):
    """P-values at even lags, where the distribution has a closed form."""
    return rounded(N.apply(events(spark, d), N.qlb, "value", U, lag=4), "value", n=6).where("time % 2 = 0")


@query(f"{SEC} SELECT DISTINCT user_id, 0::BIGINT AS time, 7.0 AS value FROM s")
def period(spark, d):
    """A series that repeats itself every seven events."""
    return N.apply(seconds(spark, d).withColumn("x", (F.col("i") % 7).cast("double")), N.period, "x", U)


@query(f"{SEC} SELECT user_id, i * 1000000 AS time, CASE i WHEN 1 THEN 38.0 ELSE 2.0 END AS value FROM s WHERE i IN (1, 21)")
def segment(spark, d):
    """A fall and a rise: two lines."""
    return rounded(N.apply(seconds(spark, d).withColumn("x", F.abs(F.col("i") - 20) * 2.0), N.segment, "x", U), "value", n=6)


@query(f"""{DN}, n AS (SELECT event_type, value AS y, i, count(*) OVER (PARTITION BY event_type) AS n FROM s), d AS (SELECT *, lead(y) OVER o - y AS d FROM n WINDOW o AS (PARTITION BY event_type ORDER BY i)),
w AS (SELECT *, lag(d) OVER o AS b, abs(lead(d) OVER o - d) AS wp, abs(lag(d) OVER o - lag(d, 2) OVER o) AS wm, lead(y) OVER o AS y1, lead(y, 2) OVER o AS y2, lag(y) OVER o AS z1, lag(y, 2) OVER o AS z2 FROM d WINDOW o AS (PARTITION BY event_type ORDER BY i)),
m AS (SELECT *, CASE WHEN i = 1 THEN (-3 * y + 4 * y1 - y2) / 2 WHEN i = n THEN (3 * y - 4 * z1 + z2) / 2 WHEN i IN (2, n - 1) THEN (y1 - z1) / 2 ELSE (wp * b + wm * d) / (wp + wm) END AS m FROM w),
h AS (SELECT event_type, i, n, y, (y + lead(y) OVER o) / 2 + (m - lead(m) OVER o) / 8 AS half FROM m WINDOW o AS (PARTITION BY event_type ORDER BY i))
SELECT event_type, {S} + (i - 1) * {DAY} AS time, round(y * 0.7310585786, 4) AS value FROM h UNION ALL SELECT event_type, {S} + (i - 1) * {DAY} + {DAY // 2}, round(half * 0.7310585786, 4) FROM h WHERE i < n""")
def spline(spark, d):
    """All points of a regular series, and the values half way between them; scaled as those of ``acf_events``."""
    return rounded(N.apply(daily(spark, d), N.spline, "value", T, points=59).withColumn("value", F.col("value") * 0.7310585786), "value")


@query(f"{DN}, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.i - b.i AS k, sum(a.value * b.value) AS t FROM (SELECT * FROM s WHERE event_type = 'click') a, (SELECT * FROM s WHERE event_type = 'purchase') b GROUP BY 1) SELECT 'all' AS device, n + k AS time, round(t / (n - abs(k)), 4) AS value FROM p, n WHERE event_type = 'click'")
def xcorr(spark, d):
    x = daily(spark, d)
    a, b = (x.where(F.col("event_type") == k).select("time", F.col("value").alias(k)) for k in ("click", "purchase"))
    return rounded(N.apply(a.join(b, "time").withColumn("device", F.lit("all")), N.xcorr, ["click", "purchase"], ["device"]), "value")


@query(f"{SEC}, p AS (SELECT a.user_id, a.i - b.i AS k, any_value(a.n) AS n, sum(a.value * b.value) AS t FROM s a JOIN s b USING (user_id) GROUP BY 1, 2) SELECT user_id, n + k AS time, round(t / (n - abs(k)) * 0.7310585786, 4) AS value FROM p")
def acf_events(spark, d):
    """Scaled, so that no result ends half way between two decimals."""
    return rounded(N.apply(events(spark, d), N.acf, "value", U).withColumn("value", F.col("value") * 0.7310585786), "value")


@query(f"{SEC} SELECT user_id, value, t AS time FROM s WHERE i <= 0")
def no_rows(spark, d):
    """An empty series has no numbers."""
    return N.apply(events(spark, d).where("user_id < 0"), N.pacf, "value", U).select(*U, "value", "time")


@query(f"{SEC} SELECT user_id, value AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k FROM s) WHERE k = ceil(0.9 * n)")
def quantile(spark, d):
    """The sketch is exact for series shorter than its accuracy."""
    return SE.quantile(events(spark, d), "value", 0.9, U)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark, d):
    return SE.distinct(events(spark, d), "event_type", U)


# matching


@query(f"{SEC}, w AS (SELECT user_id, t AS time, (value - lead(value, 9) OVER (PARTITION BY user_id ORDER BY i)) ^ 2 AS value FROM s) SELECT user_id, time, round(value, 4) AS value FROM w WHERE value <= 900")
def ptnsym(spark, d):
    return rounded(N.apply(events(spark, d), N.ptnsym, "value", U, window=10, threshold=900.0), "value")


@query(f"{SEC}, w AS (SELECT user_id, t AS time, value AS a, lead(value) OVER o AS b, lead(value, 2) OVER o AS c, lead(value, 3) OVER o AS e FROM s WINDOW o AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, time, round((a - e) ^ 2 + least((b - c) ^ 2, (a - c) ^ 2 + 0 * b, (b - e) ^ 2 + 0 * c), 4) AS value FROM w WHERE e IS NOT NULL")
def ptnsym_mirrored(spark, d):
    """Windows of four: the ends, and the best of the inner pair and of the two triples."""
    return rounded(N.apply(events(spark, d), N.ptnsym, "value", U, window=4, mirrored=True), "value")


# repair


@query(f"WITH {EV}, {DAILY} SELECT event_type, time, CASE WHEN (time - {S}) // {DAY} % 5 <> 2 THEN round(value, 6) END AS value FROM daily")
def timestamp_repair(spark, d):
    """Every fifth day is missing and comes back without a value."""
    out = N.apply(_days(spark, d).where("k % 5 <> 2"), R.timestamp_repair, "value", T, method="mode")
    return rounded(out, "value", n=6).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query(f"WITH {EV}, {DAILY} SELECT event_type, time, CASE WHEN (time - {S}) // {DAY} % 5 <> 2 THEN round(value, 6) END AS value FROM daily")
def timestamp_repair_moved(spark, d):
    """Points up to a second off the grid are moved back, missing ones inserted."""
    off = F.when(F.col("k") % 3 == 1, 400_000).when(F.col("k") % 7 == 6, -1_000_000).otherwise(0)
    out = N.apply(_days(spark, d).where("k % 5 <> 2").withColumn("time", F.col("time") + off), R.timestamp_repair, "value", T, interval=DAY)
    return rounded(out, "value", n=6).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _filled(method: str, source=holes, column: str = "x", n: int = 4):
    def run(spark, d):
        return rounded(known(SE.value_fill(source(spark, d), column, U, method=method)), "value", n=n)

    return run


def _gaps(spark, d):
    return events(spark, d).withColumn("x", F.coalesce("v", F.lit(NAN)))


def _register(name: str, sql: str, run) -> None:
    run.__name__ = name
    query(sql)(run)


_register("valuefill_mean", f"{SEC} SELECT user_id, t AS time, round(coalesce(v, avg(v) OVER (PARTITION BY user_id)), 7) AS value FROM s", _filled("mean", _gaps, n=7))
_register("valuefill_previous", f"{SEC}, f AS (SELECT user_id, t AS time, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS value FROM s) SELECT user_id, time, round(value, 4) AS value FROM f WHERE value IS NOT NULL", _filled("previous", _gaps))
_register(
    "valuefill_ar",
    f"""{SEC}, p AS (SELECT *, coalesce(v, 0) AS x, lead(coalesce(v, 0)) OVER o AS x1, lead(v) OVER o AS v1, last_value(v IGNORE NULLS) OVER o AS y, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER o AS b FROM s WINDOW o AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT user_id, sum(x * x1) / sum(CASE WHEN i < n THEN x * x END) AS a, avg(v) AS m FROM p GROUP BY 1), e AS (SELECT user_id, a, any_value(m) AS m, avg(v1 - a * v) AS e FROM p JOIN a USING (user_id) GROUP BY 1, 2)
SELECT user_id, t AS time, round(a ^ (i - coalesce(b, 1)) * coalesce(y, m) + e * (1 - a ^ (i - coalesce(b, 1))) / (1 - a), 7) AS value FROM p JOIN e USING (user_id)""",
    _filled("ar", _gaps, n=7),
)
_register(
    "valuefill_ma",
    f"""{SEC}, c AS (SELECT *, sum(v) OVER o AS c, count(v) OVER o AS k, least(n, 4 + greatest(0, least(i - 2, n - 4) - 2)) AS e FROM s WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT a.user_id, a.t AS time, round(coalesce(a.v, b.c / b.k), 7) AS value FROM c a JOIN c b ON a.user_id = b.user_id AND b.i = a.e WHERE a.v IS NOT NULL OR b.k > 0""",
    _filled("ma", _gaps, n=7),
)
HOLES = f"{SEC}, h AS (SELECT *, CASE WHEN i % 6 <> 3 THEN value END AS x FROM s)"
_register(
    "valuefill_likelihood",
    f"""{HOLES}, w AS (SELECT *, lag(x, 2) OVER o AS a, lag(x) OVER o AS b, lead(x) OVER o AS c, lead(x, 2) OVER o AS e FROM h WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i * 1000000 AS time, round(coalesce(x, CASE WHEN e IS NULL THEN -((a - 2 * b) - 2 * (b + c)) / 5 ELSE -((a - 2 * b) - 2 * (b + c) + (e - 2 * c)) / 6 END), 7) AS value FROM w WHERE x IS NOT NULL OR i < n""",
    _filled("likelihood", n=7),
)
_register(
    "valuefill_screen",
    f"""{HOLES}, p AS (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY i) AS q FROM h), m AS (SELECT user_id, median(q) AS m FROM p GROUP BY 1), z AS (SELECT user_id, any_value(m) - 3 * 1.4826 * median(abs(q - m)) AS lo, any_value(m) + 3 * 1.4826 * median(abs(q - m)) AS hi FROM p JOIN m USING (user_id) GROUP BY 1),
g AS (SELECT h.user_id, h.i, count(*) AS k, list_sort(list_concat(list(j.x - lo * (j.i - h.i)), list(j.x - hi * (j.i - h.i)))) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM h JOIN h j ON h.user_id = j.user_id AND j.i BETWEEN h.i + 1 AND h.i + 5 JOIN z ON z.user_id = h.user_id WHERE h.x IS NULL GROUP BY 1, 2),
f AS (SELECT g.user_id, g.i, greatest(least(c[k + 1], b.x + hi), b.x + lo) AS f FROM g JOIN h b ON b.user_id = g.user_id AND b.i = g.i - 1)
SELECT user_id, i * 1000000 AS time, round(coalesce(x, f), 7) AS value FROM h LEFT JOIN f USING (user_id, i) WHERE x IS NOT NULL OR f IS NOT NULL""",
    _filled("screen", n=7),
)


# frequency


DFT = f"{DN}, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), f AS (SELECT event_type, k, any_value(n) AS n, sum(value * cos(2 * pi() * k * (i - 1) / n)) AS re, -sum(value * sin(2 * pi() * k * (i - 1) / n)) AS im FROM (SELECT *, unnest(range(0, n)) AS k FROM s JOIN n USING (event_type)) GROUP BY 1, 2)"


@query(f"{DFT} SELECT event_type, k AS time, round(sqrt(re * re + im * im), 4) AS value FROM f")
def fft_abs(spark, d):
    return rounded(N.apply(daily(spark, d), N.fft, "value", T), "value")


@query(f"{DFT} SELECT event_type, k AS time, round(re, 4) + 0.0 AS value FROM f")
def fft_real(spark, d):
    return rounded(N.apply(daily(spark, d), N.fft, "value", T, result="real"), "value").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"{DFT}, e AS (SELECT *, re * re + im * im AS e FROM f), t AS (SELECT event_type, sum(e) AS t FROM e GROUP BY 1), c AS (SELECT e.*, t, sum(CASE WHEN k = 0 THEN e ELSE 2 * e END) OVER (PARTITION BY event_type ORDER BY k) - CASE WHEN k = 0 THEN e ELSE 2 * e END AS c FROM e JOIN t USING (event_type)) SELECT event_type, k AS time, round(sqrt(e), 4) AS value FROM c WHERE k <= n // 2 AND (k <= 1 OR c <= 0.97 * t) UNION ALL SELECT event_type, k, round(sqrt(e), 4) FROM c WHERE k = n - 1")
def fft_compressed(spark, d):
    return rounded(N.apply(daily(spark, d), N.fft, "value", T, compress=0.97), "value")


@query(f"{SEC}, f AS (SELECT user_id, k, sum(value * cos(2 * pi() * k * (i - 1) / n)) AS re, sum(value * sin(2 * pi() * k * (i - 1) / n)) AS im FROM (SELECT *, unnest(range(0, n)) AS k FROM s) GROUP BY 1, 2) SELECT user_id, k AS time, round(sqrt(re * re + im * im), 3) AS value FROM f")
def fft_abs_events(spark, d):
    return rounded(N.apply(events(spark, d), N.fft, "value", U), "value", n=3)


BACK = "x AS (SELECT f.event_type, j.time, sum(re * cos(2 * pi() * k * (j.i - 1) / n) - im * sin(2 * pi() * k * (j.i - 1) / n)) / any_value(n) AS value FROM f JOIN (SELECT event_type, time, row_number() OVER (PARTITION BY event_type ORDER BY time) AS i FROM daily) j USING (event_type) WHERE {keep} GROUP BY 1, 2) SELECT event_type, time, round(value, 4) AS value FROM x"


@query(f"{DFT}, " + BACK.format(keep="k < ceil(0.4 * n / 2) OR k > n - ceil(0.4 * n / 2)"))
def lowpass(spark, d):
    return rounded(N.apply(daily(spark, d), N.lowpass, "value", T, wpass=0.4), "value")


@query(f"{DFT}, " + BACK.format(keep="k > floor(0.4 * n / 2) AND k < n - floor(0.4 * n / 2)"))
def highpass(spark, d):
    return rounded(N.apply(daily(spark, d), N.highpass, "value", T, wpass=0.4), "value")


PADDED = f"{SEC}, p AS (SELECT user_id, unnest(range(0, 128)) AS k, any_value(n) AS n FROM s GROUP BY 1), x AS (SELECT p.user_id, k, value FROM p JOIN s ON s.user_id = p.user_id AND s.i = least(k + 1, p.n)), h AS (SELECT user_id, k // 2 AS k, (max(value) FILTER (k % 2 = 0) + max(value) FILTER (k % 2 = 1)) / sqrt(2) AS a, (max(value) FILTER (k % 2 = 0) - max(value) FILTER (k % 2 = 1)) / sqrt(2) AS b FROM x GROUP BY 1, 2), g AS (SELECT user_id, k // 2 AS k, (max(a) FILTER (k % 2 = 0) + max(a) FILTER (k % 2 = 1)) / sqrt(2) AS a, (max(a) FILTER (k % 2 = 0) - max(a) FILTER (k % 2 = 1)) / sqrt(2) AS b FROM h GROUP BY 1, 2)"


@query(f"{PADDED} SELECT user_id, k AS time, round(a, 4) + 0.0 AS value FROM g UNION ALL SELECT user_id, 32 + k, round(b, 4) + 0.0 FROM g UNION ALL SELECT user_id, 64 + k, round(b, 4) + 0.0 FROM h")
def dwt_haar(spark, d):
    """Two layers forward; the last value is repeated up to 128."""
    padded = lambda t, v: N.dwt(t, np.pad(v, (0, 128 - len(v)), "edge"), "haar", layer=2)
    return rounded(N.apply(events(spark, d), padded, "value", U), "value").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"{SEC} SELECT user_id, i - 1 AS time, round(value, 4) AS value FROM s")
def deconv(spark, d):
    """A product of polynomials, divided by one of them."""
    both = lambda t, v: N.deconv(t, np.convolve(v, [1.0, 2.0]), np.array([1.0, 2.0]))
    return rounded(N.apply(events(spark, d), both, "value", U), "value")


# queries without SQL: each value depends on what was made of those before


def _numeric(name, function, by=("user_id",), source=events, **parameters):
    def run(spark, d):
        return rounded(N.apply(source(spark, d), function, "value", list(by), **parameters), "value", n=6)

    QUERIES[name] = run


_numeric("lof_series_events", N.lof_series)
_numeric("sample_triangle_events", N.sample_triangle, k=9)
_numeric("swing_door_events", N.swing_door, deviation=5.0)
_numeric("value_repair_screen_events", R.screen)
_numeric("value_repair_lsgreedy_events", R.ls_greedy)


# filters, windows and fills


@query(f"WITH {EV} SELECT event_id, time FROM ev WHERE time IN (SELECT min(time) FROM ev UNION SELECT max(time) FROM ev) OR (event_type = 'click' AND user_id NOT IN (1, 2) AND time % 1000 IN (0, 500))")
def time_in(spark, d):
    e = events(spark, d)
    first, last = e.agg(F.min("time"), F.max("time")).first()
    return e.where(F.col("time").isin(first, last) | ((F.col("event_type") == "click") & ~F.col("user_id").isin(1, 2) & (F.col("time") % 1000).isin(0, 500))).select("event_id", "time")


@query("SELECT o_orderkey FROM orders, (SELECT unnest(range(0, 90)) AS k) WHERE o_orderdate >= TIMESTAMP '1995-01-31' + to_months((2 * k)::INT) AND o_orderdate < TIMESTAMP '1995-01-31' + to_months((2 * k + 1)::INT) AND o_orderdate < TIMESTAMP '2001-01-01'")
def group_by_month_filter(spark, d):
    o = table(spark, d, "orders").select(micros(F.col("o_orderdate")).alias("time"), "o_orderkey")
    return o.where(W.group_by_filter(F.col("time"), "1995-01-31", "2001-01-01", "1mo", "2mo")).select("o_orderkey")


@query("WITH k AS (SELECT unnest(range(0, 90)) AS k), w AS (SELECT TIMESTAMP '1995-01-31' + to_months(k::INT) + to_days(k::INT) AS a, least(TIMESTAMP '2000-06-15', TIMESTAMP '1995-01-31' + to_months((k + 1)::INT) + to_days((k + 1)::INT)) AS b FROM k) SELECT epoch_us(a) AS time, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM w LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < b WHERE a < TIMESTAMP '2000-06-15' GROUP BY a")
def window_mixed_duration(spark, d):
    return _months(spark, d, "1995-01-31", "2000-06-15", "1mo1d")


@query(MONTHS.format(n=9, start="1995-02-01", end="2001-08-01", step=12, size=24))
def window_years_sliding(spark, d):
    return _months(spark, d, "1995-02-01", "2001-08-01", "2y", "1y")


@query(f"WITH RECURSIVE {EV}, n AS (SELECT user_id, time, v, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i FROM ev), f AS (SELECT user_id, time, v, i, v AS head, 0 AS w FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.time, n.v, n.i, CASE WHEN (n.v IS NULL) <> (f.head IS NULL) OR coalesce(abs(n.v - f.head) > 30, false) THEN n.v ELSE f.head END, f.w + CASE WHEN (n.v IS NULL) <> (f.head IS NULL) OR coalesce(abs(n.v - f.head) > 30, false) THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT user_id, min(time) AS time, max(time) AS end_time, count(*) AS rows, count(v) AS n FROM f GROUP BY user_id, w")
def window_variation_nulls(spark, d):
    return W.group_by_variation(events(spark, d), "v", 30, [F.count("*").alias("rows"), F.count("v").alias("n")], U, ignore_null=False, columns=[])


@query(f"WITH {EV} SELECT event_type, time, 0 AS missing FROM ev WHERE value > 300")
def null_operand(spark, d):
    """A series that isn't there is null, and conditions on it don't hold."""
    e = events(spark, d).withColumn("gone", column_or_null(events(spark, d), "gone"))
    return e.where((F.col("value") > 300) & ~F.coalesce(F.col("gone") > 1, F.lit(False))).select("event_type", "time", F.count("gone").over(Window.partitionBy("time")).cast("int").alias("missing"))


@query(f"WITH {EV} SELECT user_id, time, 'value' AS measurement, value FROM ev UNION ALL SELECT user_id, time, 'v', v FROM ev WHERE v IS NOT NULL")
def disable_align(spark, d):
    return to_long(events(spark, d).select("user_id", "time", "value", "v"), ["value", "v"], ("user_id", "time"))


@query(f"WITH {EV} SELECT event_id, CAST(trunc(value) AS INT) AS i, CAST(value > 50 AS VARCHAR) AS b, CAST(user_id AS DOUBLE) AS x, TRY_CAST(event_type AS INT) AS bad FROM ev")
def cast_types(spark, d):
    return events(spark, d).select("event_id", F.col("value").cast("int").alias("i"), (F.col("value") > 50).cast("string").alias("b"), F.col("user_id").cast("double").alias("x"), F.col("event_type").try_cast("int").alias("bad"))


@query(f"WITH {EV}, {GRID}, x AS (SELECT *, last_value(high IGNORE NULLS) OVER a AS p, first_value(high IGNORE NULLS) OVER b AS q FROM grid WINDOW a AS (PARTITION BY event_type ORDER BY time), b AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_type, time, n, CASE WHEN q IS NOT NULL THEN p END AS high FROM x")
def fill_until_last(spark, d):
    return FI.fill(_grid(spark, d), "previousuntillast", ["high"], [F.col("time")], by=T)


@query(f"WITH {EV}, {GRID}, {CONS} SELECT event_type, time, length FROM s WHERE length > 1")
def consecutive_sequences_auto(spark, d):
    """The gap is the most frequent step, an hour."""
    return SE.consecutive_sequences(_grid(spark, d), ["high"], None, T)


@query(f"WITH {EV}, z AS (SELECT user_id, time, v IS NULL AS z FROM ev), g AS (SELECT *, sum(CASE WHEN z THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY time) AS k FROM z) SELECT user_id, min(time) AS time, count(*) AS count, max(time) - min(time) AS duration FROM g WHERE NOT z GROUP BY user_id, k")
def non_zero_runs(spark, d):
    return SE.zero_runs(events(spark, d).withColumn("z", F.coalesce("v", F.lit(0.0))), "z", U, zero=False)


@query(f"""{SEC}, g AS (SELECT user_id, (i - 1) // 10 AS k, min((t, value)) AS f, max((t, value)) AS l, min((value, t)) AS b, max((value, -t)) AS h FROM s GROUP BY 1, 2),
p AS (SELECT user_id, f[1] AS time, f[2] AS value FROM g UNION SELECT user_id, b[2], b[1] FROM g WHERE b[2] <> f[1] AND b[1] <> l[2] UNION SELECT user_id, -h[2], h[1] FROM g WHERE -h[2] <> f[1] AND h[1] <> l[2] UNION SELECT user_id, l[1], l[2] FROM g) SELECT * FROM p""")
def m4_by_count(spark, d):
    return SE.m4_by_count(events(spark, d), "value", 10, U)


@query(f"WITH RECURSIVE {EV}, n AS (SELECT user_id, time, value, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i FROM ev), f AS (SELECT user_id, time, value, i, time AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.time, n.value, n.i, CASE WHEN n.time - f.last >= {12 * HOUR} THEN n.time ELSE f.last END, n.time - f.last >= {12 * HOUR} FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT user_id, time, value FROM f WHERE kept")
def down_sample(spark, d):
    return N.apply(events(spark, d), N.down_sample, "value", U, interval=12 * HOUR)


@query(f"WITH {EV}, x AS (SELECT user_id, time, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY time)) AS diff FROM ev) SELECT user_id, time, diff FROM x WHERE diff IS NOT NULL")
def difference(spark, d):
    return SE.difference(events(spark, d), "value", U, absolute=True)


@query("SELECT event_id, lower(upper(event_type)) AS low, replace(event_type, 'l', 'LL') AS rep, 7::BIGINT AS c, round(exp(1.0), 6) AS e, round(pi(), 6) AS pi FROM events")
def scalars_more(spark, d):
    t = F.col("event_type")
    return events(spark, d).select("event_id", F.lower(F.upper(t)).alias("low"), SC.str_replace(t, "l", "LL").alias("rep"), SC.const("7", "int64").alias("c"), F.round(SC.E_(), 6).alias("e"), F.round(SC.PI(), 6).alias("pi"))


# catalogue and targets


def _catalog(spark, d):
    return events(spark, d).withColumn("device", F.concat(F.lit("root."), "event_type", F.lit(".u"), F.col("user_id")))


@query("SELECT DISTINCT 'root.' || event_type || '.u' || user_id || '.' || m AS timeseries, 'double' AS data_type FROM (SELECT *, unnest(['value', 'v']) AS m FROM events) WHERE m = 'value' OR value >= 20")
def show_timeseries(spark, d):
    return SH.show_timeseries(_catalog(spark, d), ["value", "v"])


@query("SELECT n_nationkey AS device FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(r_name, 'AS') AND contains(n_name, 'I')")
def contains_tags(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    tags = n.join(g, n.n_regionkey == g.r_regionkey).select(F.col("n_nationkey").alias("device"), F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name").alias("tags"))
    return SH.with_tags(tags, region="AS", nation="I").select("device")


@query(f"WITH {EV} SELECT event_id, v FROM ev WHERE v IS NOT NULL AND user_id IS NOT NULL")
def without_null_any(spark, d):
    return SH.without_null(events(spark, d), ["v", "user_id"], "ANY").select("event_id", "v")


@query(f"WITH {EV}, {DAILY}, a AS (SELECT 'root.copy.' || event_type AS device, time, 'mean' AS measurement, value AS value FROM daily WHERE event_type IN ('click', 'purchase')) SELECT device, time, measurement, round(CASE WHEN time < {S + 10 * DAY} THEN value ELSE -value END, 4) AS value FROM a")
def select_into(spark, d):
    """Two columns of a result go to their targets, over older points there."""
    x = daily(spark, d)
    wide = x.groupBy("time").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(f"root.days.{k}.value") for k in ("click", "purchase")])
    targets = {f"root.days.{k}.value": "root.copy.${2}.mean" for k in ("click", "purchase")}
    there = store.into_targets(wide.select("time", *[(-F.col(f"`{c}`")).alias(c) for c in targets]), targets)
    return rounded(store.into_targets(wide.where(F.col("time") < S + 10 * DAY), targets, there), "value")


# schedules and user functions


@query(f"""WITH {EV}, x AS (SELECT unnest(range({S + 7 * HOUR}, {S + 2 * DAY + 1}, {6 * HOUR})) AS execution), w AS (SELECT execution, execution - {12 * HOUR} + unnest([0, 1]) * {3 * HOUR} AS a FROM x UNION SELECT {S + HOUR}, {S - 11 * HOUR} + unnest([0, 1]) * {3 * HOUR}),
t AS (SELECT DISTINCT event_type FROM ev) SELECT w.execution, t.event_type, w.a AS time, nullif(count(value), 0) AS n, max(value) AS high FROM w CROSS JOIN t LEFT JOIN ev ON ev.event_type = t.event_type AND ev.time >= a AND ev.time < a + {3 * HOUR} GROUP BY ALL""")
def continuous_query_schedule(spark, d):
    """Every six hours from one o'clock on, over the time from twelve to six hours before."""
    aggs = [F.count("value").alias("n"), F.max("value").alias("high")]
    cq = ContinuousQuery("6h", aggs, "3h", ("event_type",), boundary=S + HOUR, start_offset="12h", end_offset="6h")
    results: list[DataFrame] = []
    for _ in cq.run(events(spark, d), S, S + 2 * DAY, lambda df, at: results.append(df.withColumn("execution", F.lit(at).cast("long")))):
        pass
    return reduce(DataFrame.unionByName, results)


class WindowSum(user.UDTF):
    """The sum of each window of ``size`` rows, at its first time."""

    def validate(self, parameters, kinds):
        if parameters.need("size", int) < 1 or kinds != ["double"]:
            raise ValueError("a series of numbers and a size above 0 are needed")

    def before_start(self, parameters):
        return user.BySize(parameters.need("size", int))

    def transform(self, rows: pd.DataFrame, collector: user.Collector):
        collector.put(rows.index[0], float(rows.iloc[:, 0].sum()))


class SquareMean(user.UDAF):
    """The mean of squares."""

    def create_state(self):
        return (0, 0.0)

    def add_input(self, state, values):
        return (state[0] + len(values), state[1] + float((values**2).sum()))

    def combine(self, state, other):
        return (state[0] + other[0], state[1] + other[1])

    def output_final(self, state):
        return state[1] / state[0] if state[0] else None


@query(f"{SEC} SELECT user_id, min(t) AS time, round(sum(value), 4) AS value FROM s GROUP BY user_id, (i - 1) // 7")
def udtf_window_sum(spark, d):
    return rounded(user.run_udtf(events(spark, d), WindowSum, ["value"], U, size="7"), "value")


@query("SELECT event_type, round(avg(value * value), 4) AS value FROM events GROUP BY event_type")
def udaf_square_mean(spark, d):
    return rounded(user.run_udaf(events(spark, d), SquareMean, "value", T), "value")


# the SQL dialect


def database(spark, d, per_user: bool = True) -> Database:
    e = table(spark, d, "events")
    path = F.concat(F.lit("root."), "event_type", F.lit(".u"), F.col("user_id")) if per_user else F.concat(F.lit("root."), "event_type")
    out = Database(spark)
    out.register("root", e.select(path.alias("device"), micros(F.col("ts")).alias("time"), "ts", "value", F.when(F.col("value") >= 20, F.col("value")).alias("v")), ts="ts")
    return out


PATH = "'root.' || event_type || '.u' || user_id"
_DIALECT = {
    "sql_where": ("SELECT value, v + 1 AS w FROM root.c*.** WHERE time >= 2024-01-03 AND time < 2024-01-09T12:00:00 AND (value > 50 OR v IS NULL) ALIGN BY DEVICE", f"SELECT {PATH} AS device, time, value, v + 1 AS w FROM ev WHERE event_type LIKE 'c%' AND time >= {S + 2 * DAY} AND time < {S + 8 * DAY + 12 * HOUR} AND (value > 50 OR v IS NULL)"),
    "sql_missing_series": ("SELECT value FROM root.** WHERE value > 300 AND nothing IS NULL ALIGN BY DEVICE", f"SELECT {PATH} AS device, time, value FROM ev WHERE value > 300"),
    "sql_having": ("SELECT count(v) AS n, first_value(v) AS f, max_time(v) AS t, max_value(value) - min_value(value) AS s FROM root.** HAVING count(v) > 3 ALIGN BY DEVICE", f"SELECT {PATH} AS device, count(v) AS n, arg_min(v, time) FILTER (v IS NOT NULL) AS f, max(time) FILTER (v IS NOT NULL) AS t, max(value) - min(value) AS s FROM ev GROUP BY 1 HAVING count(v) > 3"),
    "sql_session": ("SELECT count(value) AS n FROM root.** GROUP BY SESSION(12h) ALIGN BY DEVICE", f", b AS (SELECT {PATH} AS device, time, CASE WHEN time - lag(time) OVER (PARTITION BY event_type, user_id ORDER BY time) > {12 * HOUR} THEN 1 ELSE 0 END AS n FROM ev), g AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY time) AS w FROM b) SELECT device, min(time) AS time, max(time) AS end_time, count(*) AS n FROM g GROUP BY device, w"),
    "sql_count_windows": ("SELECT sum(v) AS s FROM root.** GROUP BY COUNT(v, 3) ALIGN BY DEVICE", f", b AS (SELECT {PATH} AS device, time, v, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY time) - 1) // 3 AS w FROM ev WHERE v IS NOT NULL) SELECT device, min(time) AS time, max(time) AS end_time, sum(v) AS s FROM b GROUP BY device, w HAVING count(*) = 3"),
    "sql_condition": ("SELECT count(v) AS n FROM root.** GROUP BY CONDITION(v > 40, KEEP >= 2) ALIGN BY DEVICE", f", r AS (SELECT {PATH} AS device, time, v > 40 AS p FROM ev WHERE v IS NOT NULL), g AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY time) AS w FROM r) SELECT device, min(time) AS time, max(time) AS end_time, count(*) AS n FROM g WHERE p GROUP BY device, w HAVING count(*) >= 2"),
    "sql_level": ("SELECT count(value) AS n FROM root.** GROUP BY LEVEL = 1 ALIGN BY DEVICE", "SELECT 'root.' || event_type || '.*' AS device, count(*) AS n FROM ev GROUP BY 1"),
    "sql_top_k": ("SELECT top_k(value, 'k'='2') AS top FROM root.** ALIGN BY DEVICE", f"SELECT {PATH} AS device, time, value AS top FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, time) <= 2"),
    "sql_last": ("SELECT LAST value FROM root.click.** ORDER BY TIMESERIES DESC LIMIT 7", f"SELECT max(time) AS time, {PATH} || '.value' AS timeseries, CAST(arg_max(value, time) AS VARCHAR) AS value, 'double' AS data_type FROM ev WHERE event_type = 'click' GROUP BY 2 ORDER BY timeseries DESC LIMIT 7"),
    "sql_show_devices": ("SHOW DEVICES root.purchase.**", f"SELECT DISTINCT {PATH} AS device FROM ev WHERE event_type = 'purchase'"),
    "sql_count_timeseries": ("COUNT TIMESERIES root.**", "SELECT count(DISTINCT (event_type, user_id)) + count(DISTINCT CASE WHEN v IS NOT NULL THEN (event_type, user_id) END) AS count FROM ev"),
}
for _name, (_text, _sql) in _DIALECT.items():
    _register(_name, f"WITH {EV}" + (_sql if _sql.startswith(",") else " " + _sql), lambda spark, d, text=_text: database(spark, d).sql(text))


@query(f"""WITH {EV}, k AS (SELECT event_type, unnest(range(0, 60)) AS k FROM (SELECT DISTINCT event_type FROM ev WHERE event_type IN ('click', 'purchase'))),
a AS (SELECT event_type, (time - {S}) // {12 * HOUR} AS k, count(v) AS n, max(v) AS h FROM ev WHERE time >= {S} AND time < {E} GROUP BY 1, 2), j AS (SELECT k.event_type, k.k, coalesce(n, 0) AS n, last_value(h IGNORE NULLS) OVER (PARTITION BY k.event_type ORDER BY k.k) AS h FROM k LEFT JOIN a USING (event_type, k))
SELECT {S} + k * {12 * HOUR} AS time, max(n) FILTER (event_type = 'click') AS "count(root.click.v)", max(h) FILTER (event_type = 'click') AS "max_value(root.click.v)", max(n) FILTER (event_type = 'purchase') AS "count(root.purchase.v)", max(h) FILTER (event_type = 'purchase') AS "max_value(root.purchase.v)" FROM j GROUP BY k""")
def sql_align_by_time(spark, d):
    """A column for each series, windows of half a day, filled from those before."""
    return database(spark, d, per_user=False).sql("SELECT count(v), max_value(v) FROM root.click, root.purchase GROUP BY ([2024-01-01, 2024-01-31), 12h) FILL(PREVIOUS)")


@query(f"WITH {EV}, p AS (SELECT {PATH} AS device, time, CASE WHEN NOT (event_type = 'click' AND time < {S + 3 * DAY}) THEN v END AS v, value FROM ev UNION ALL SELECT 'root.click.u1', {S + 40 * DAY}, NULL, 5.5 UNION ALL SELECT 'root.click.u1', {S + 41 * DAY}, 30.0, 30.0) SELECT device, count(v) AS n, max(time) AS last, sum(value) AS s FROM (SELECT * REPLACE (round(value, 2) AS value) FROM p) GROUP BY device")
def sql_insert_delete(spark, d):
    db = database(spark, d)
    db.sql("DELETE FROM root.click.**.v WHERE time < 2024-01-04")
    db.sql("INSERT INTO root.click.u1(timestamp, value, v) VALUES (2024-02-10T00:00:00, 1, null), (2024-02-11T00:00:00, 30, 30)")
    db.sql("INSERT INTO root.click.u1(time, value) VALUES (2024-02-10T00:00:00, 5.5)")
    rows = db.tables["root"][0]
    return rows.groupBy("device").agg(F.count("v").alias("n"), F.max("time").alias("last"), F.sum(F.round("value", 2)).alias("s"))
