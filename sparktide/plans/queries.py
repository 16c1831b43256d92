"""Queries over the driver's tables, each with the same result in SQL.

``QUERIES[name]`` takes (spark, sf_dir); ``ORACLE[name]`` is for DuckDB.  Times are
microseconds; values that depend on the order of summing are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalar as SC
from ..functions import series as SE
from ..model import instant, match_path, micros, to_long, to_wide, ts_between
from ..operators import aggregates as A
from ..operators import fill as FI
from ..operators import shape as SH
from ..operators import windows as W
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END = "2024-01-01", "2024-01-31"
S, E = 1704067200000000, 1706659200000000
HOUR, DAY = 3_600_000_000, 86_400_000_000
EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS time, value, CASE WHEN value < 20 THEN NULL ELSE value END AS v, props FROM events)"
DAILY = f"daily AS (SELECT event_type, {S} + {DAY} * ((time - {S}) // {DAY}) AS time, avg(value) AS value FROM ev GROUP BY 1, 2)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The series table; ``v`` is ``value`` with nulls below 20.  Bounds on time, ends included, reach the reader."""
    e = table(spark, sf_dir, "events")
    if first is not None or last is not None:
        e = e.where(ts_between("ts", first, last))
    return e.select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("time"), "value", F.when(F.col("value") >= 20, F.col("value")).alias("v"), "props")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means per event type: a short regular series."""
    e = events(spark, sf_dir)
    day = F.lit(S) + (F.col("time") - S - F.pmod(F.col("time") - S, F.lit(DAY)))
    return e.groupBy("event_type", day.alias("time")).agg(F.avg("value").alias("value"))


def r(c, n=4):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


def rounded(df: DataFrame, *columns: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


# the flagship


@query(f"""WITH {EV}, t AS (SELECT DISTINCT event_type FROM ev), w AS (SELECT event_type, unnest(range(0, 720)) AS k FROM t),
a AS (SELECT event_type, (time - {S}) // {HOUR} AS k, count(v) AS n, round(avg(v), 4) AS mean, arg_max(v, time) FILTER (v IS NOT NULL) AS last FROM ev WHERE time >= {S} AND time < {E} GROUP BY 1, 2),
j AS (SELECT w.event_type, {S} + w.k * {HOUR} AS time, coalesce(n, 0) AS n, mean, last FROM w LEFT JOIN a USING (event_type, k))
SELECT event_type, time, n, last_value(mean IGNORE NULLS) OVER o AS mean, last_value(last IGNORE NULLS) OVER o AS last FROM j WINDOW o AS (PARTITION BY event_type ORDER BY time)""")
def downsample_fill(spark, d):
    e = events(spark, d, S, E)
    aggs = [A.count("v").alias("n"), r(A.avg("v")).alias("mean"), A.last_value("v").alias("last")]
    grid = W.group_by_time(e, START, END, "1h", aggs, by=["event_type"], zero=("n",))
    return FI.fill_previous(grid, ["mean", "last"], [F.col("time")], by=["event_type"])


# filters


@query(f"WITH {EV} SELECT event_id, time, value FROM ev WHERE time BETWEEN {S + DAY} AND {S + 3 * DAY}")
def time_range(spark, d):
    return events(spark, d, S + DAY, S + 3 * DAY).where(F.col("time").between(S + DAY, S + 3 * DAY)).select("event_id", "time", "value")


@query(f"WITH {EV} SELECT event_id, time FROM ev WHERE time NOT BETWEEN {S + DAY} AND {S + 29 * DAY}")
def time_not_between(spark, d):
    return events(spark, d).where(~F.col("time").between(S + DAY, S + 29 * DAY)).select("event_id", "time")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND user_id NOT IN (1, 2, 3)")
def value_in(spark, d):
    e = table(spark, d, "events")
    return e.where(F.col("event_type").isin("click", "purchase") & ~F.col("user_id").isin(1, 2, 3)).select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#0000000_1' AND c_name NOT LIKE '%2_'")
def like(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").where(n.like("%#0000000_1") & ~n.like("%2_")).select("c_custkey", "c_name")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '[0-9]{2}') AND NOT regexp_matches(url, '7$')")
def regexp(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").where(u.rlike("[0-9]{2}") & ~u.rlike("7$")).select("page_id", "url")


@query(f"WITH {EV} SELECT event_id, v IS NULL AS missing FROM ev WHERE v IS NULL OR v >= 100")
def null_filter(spark, d):
    return events(spark, d).where(F.col("v").isNull() | (F.col("v") >= 100)).select("event_id", F.col("v").isNull().alias("missing"))


@query(f"WITH {EV} SELECT event_id, time FROM ev WHERE time >= {S + DAY} AND time < {S + 20 * DAY} AND (time - {S + DAY}) % {6 * HOUR} < {HOUR}")
def group_by_filter(spark, d):
    return events(spark, d, S + DAY, S + 20 * DAY).where(W.group_by_filter(F.col("time"), S + DAY, S + 20 * DAY, "1h", "6h")).select("event_id", "time")


@query(f"WITH {EV} SELECT event_id, value + 1 AS plus, value - user_id AS minus, value * 2 AS times, value / nullif(user_id % 3, 0) AS divided, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value % (user_id % 3) END AS rest FROM ev")
def arithmetic(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return events(spark, d).select("event_id", SC.arithmetic(v, "+", F.lit(1)).alias("plus"), SC.arithmetic(v, "-", u).alias("minus"), SC.arithmetic(v, "*", F.lit(2)).alias("times"), SC.arithmetic(v, "/", u % 3).alias("divided"), SC.arithmetic(v, "%", u % 3).alias("rest"))


# aggregates


@query(f"WITH {EV} SELECT user_id, count(v) AS n, count(*) AS rows, sum(v) IS NULL AS empty, round(sum(v), 4) AS total, round(avg(v), 4) AS mean FROM ev GROUP BY user_id")
def count_sum_avg(spark, d):
    return events(spark, d).groupBy("user_id").agg(A.count("v").alias("n"), F.count("*").alias("rows"), A.sum_("v").isNull().alias("empty"), r(A.sum_("v")).alias("total"), r(A.avg("v")).alias("mean"))


@query(f"WITH {EV} SELECT event_type, count(DISTINCT CASE WHEN v IS NOT NULL OR user_id > 5 THEN time END) AS n FROM ev GROUP BY event_type")
def count_time(spark, d):
    e = events(spark, d).withColumn("u", F.when(F.col("user_id") > 5, F.col("user_id")))
    return e.groupBy("event_type").agg(A.count_time("time", "v", "u").alias("n"))


@query(f"WITH {EV} SELECT user_id, min(v) AS low, max(v) AS high, max(v) - min(v) AS spread FROM ev GROUP BY user_id")
def extremes(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), A.spread("v").alias("spread"))


@query(f"WITH {EV} SELECT user_id, min(time) FILTER (v IS NOT NULL) AS first_time, max(time) FILTER (v IS NOT NULL) AS last_time, max(time) FILTER (v IS NOT NULL) - min(time) FILTER (v IS NOT NULL) AS duration FROM ev GROUP BY user_id")
def min_max_time(spark, d):
    return events(spark, d).groupBy("user_id").agg(A.min_time("v").alias("first_time"), A.max_time("v").alias("last_time"), A.time_duration("v").alias("duration"))


@query(f"WITH {EV} SELECT user_id, arg_min(v, time) FILTER (v IS NOT NULL) AS first, arg_max(v, time) FILTER (v IS NOT NULL) AS last FROM ev GROUP BY user_id")
def first_last_value(spark, d):
    return events(spark, d).groupBy("user_id").agg(A.first_value("v").alias("first"), A.last_value("v").alias("last"))


@query(f"WITH {EV}, x AS (SELECT user_id, time, value, round(value / 50) AS y FROM ev) SELECT DISTINCT user_id, first_value(value) OVER (PARTITION BY user_id ORDER BY y DESC, time) AS at_max, first_value(value) OVER (PARTITION BY user_id ORDER BY y, time) AS at_min FROM x")
def max_min_by(spark, d):
    e = events(spark, d).withColumn("y", F.round(F.col("value") / 50))
    return e.groupBy("user_id").agg(A.max_by("value", "y").alias("at_max"), A.min_by("value", "y").alias("at_min"))


@query(f"WITH {EV} SELECT user_id, arg_max(value - 60, abs(value - 60)) AS extreme FROM ev GROUP BY user_id")
def extreme(spark, d):
    return events(spark, d).withColumn("c", F.col("value") - 60).groupBy("user_id").agg(A.extreme("c").alias("extreme"))


@query(f"WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n, min(time) AS t FROM ev GROUP BY ALL) SELECT DISTINCT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY n DESC, t) AS mode FROM c")
def mode(spark, d):
    return A.mode(events(spark, d), "event_type", ["user_id"])


@query(f"WITH {EV} SELECT event_type, round(stddev_samp(v), 4) AS sd, round(stddev_pop(v), 4) AS sd_pop, round(var_samp(v), 2) AS var, round(var_pop(v), 2) AS var_pop FROM ev GROUP BY event_type")
def stddev_var(spark, d):
    return events(spark, d).groupBy("event_type").agg(r(A.stddev("v")).alias("sd"), r(A.stddev_pop("v")).alias("sd_pop"), r(A.variance("v"), 2).alias("var"), r(A.var_pop("v"), 2).alias("var_pop"))


RUNS = "r AS (SELECT user_id, time, value > 40 AS p FROM ev WHERE v IS NOT NULL), g AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY time) AS run FROM r), l AS (SELECT user_id, run, count(*) AS n, min(time) AS time, max(time) AS end_time FROM g WHERE p GROUP BY 1, 2)"


@query(f"WITH {EV}, {RUNS} SELECT u.user_id, (SELECT count(*) FROM l WHERE l.user_id = u.user_id AND n >= 3) AS count_if FROM (SELECT DISTINCT user_id FROM ev) u")
def count_if_ge(spark, d):
    return A.count_if(events(spark, d), F.col("v") > 40, 3, ["user_id"])


@query(f"WITH {EV}, {RUNS} SELECT u.user_id, (SELECT count(*) FROM l WHERE l.user_id = u.user_id AND n < 3) AS count_if FROM (SELECT DISTINCT user_id FROM ev) u")
def count_if_lt(spark, d):
    return A.count_if(events(spark, d), F.col("v") > 40, "keep<3", ["user_id"])


@query(f"WITH {EV} SELECT user_id, round(avg(value) + 1, 4) AS mean FROM ev GROUP BY user_id HAVING max(value) > 200 AND count(v) > 10")
def having(spark, d):
    g = events(spark, d).groupBy("user_id").agg(r(F.avg("value") + 1).alias("mean"), F.max("value").alias("m"), F.count("v").alias("n"))
    return g.where("m > 200 AND n > 10").select("user_id", "mean")


# time windows


def windows_sql(start, end, interval, step, left_open=False):
    n = -(-(end - start) // step)
    inside = "time > a AND time <= b" if left_open else "time >= a AND time < b"
    return f"""WITH {EV}, t AS (SELECT DISTINCT event_type FROM ev), k AS (SELECT event_type, unnest(range(0, {n})) AS k FROM t),
w AS (SELECT event_type, {start} + k * {step} AS a, least({end}, {start} + k * {step} + {interval}) AS b FROM k)
SELECT w.event_type, w.{"b" if left_open else "a"}::BIGINT AS time, count(value) AS n, max(value) AS high FROM w LEFT JOIN ev ON ev.event_type = w.event_type AND {inside} GROUP BY ALL"""


def _by_time(spark, d, *args, **more):
    return W.group_by_time(events(spark, d, instant(args[0]), instant(args[1])), *args, [A.count("value").alias("n"), F.max("value").alias("high")], by=["event_type"], zero=("n",), **more)


@query(windows_sql(S, E, HOUR, HOUR))
def window_tumbling_empty(spark, d):
    return _by_time(spark, d, START, END, "1h")


@query(windows_sql(S, S + 10 * DAY + 7, HOUR, 5 * HOUR))
def window_sampling_gap(spark, d):
    return _by_time(spark, d, S, S + 10 * DAY + 7, "1h", step="5h")


@query(windows_sql(S, S + 20 * DAY, 6 * HOUR, 4 * HOUR))
def window_sliding(spark, d):
    return _by_time(spark, d, S, S + 20 * DAY, "6h", step="4h")


@query(windows_sql(S, S + 9 * DAY + 5, 2 * DAY, 2 * DAY, True))
def window_left_open(spark, d):
    return _by_time(spark, d, S, S + 9 * DAY + 5, "2d", left_open=True)


MONTHS = """WITH k AS (SELECT unnest(range(0, {n})) AS k), w AS (SELECT TIMESTAMP '{start}' + to_months((k * {step})::INT) AS a, least(TIMESTAMP '{end}', TIMESTAMP '{start}' + to_months((k * {step} + {size})::INT)) AS b FROM k)
SELECT epoch_us(a) AS time, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM w LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < b WHERE a < TIMESTAMP '{end}' GROUP BY a"""


def _months(spark, d, start, end, interval, step=None):
    o = table(spark, d, "orders").where(ts_between("o_orderdate", instant(start), instant(end))).select(micros(F.col("o_orderdate")).alias("time"), "o_totalprice")
    return W.group_by_time(o, start, end, interval, [F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")], step=step, zero=("n",))


@query(MONTHS.format(n=90, start="1995-01-31", end="2001-08-15", step=1, size=1))
def window_month(spark, d):
    return _months(spark, d, "1995-01-31", "2001-08-15", "1mo")


@query(MONTHS.format(n=40, start="1995-10-31", end="2001-01-01", step=3, size=1))
def window_month_sampling(spark, d):
    return _months(spark, d, "1995-10-31", "2001-01-01", "1mo", "3mo")


# row windows


@query(f"WITH {EV}, b AS (SELECT *, CASE WHEN time - lag(time) OVER o > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY time) AS w FROM b) SELECT user_id, min(time) AS time, max(time) AS end_time, count(*) AS rows, max(value) AS high FROM g GROUP BY user_id, w")
def window_session(spark, d):
    return W.group_by_session(events(spark, d), "6h", [F.count("*").alias("rows"), F.max("value").alias("high")], ["user_id"])


@query(f"WITH {EV}, {RUNS} SELECT user_id, time, end_time, n AS rows FROM l WHERE n >= 2")
def window_condition(spark, d):
    return W.group_by_condition(events(spark, d), F.col("v") > 40, 2, [F.count("*").alias("rows")], ["user_id"])


@query(f"WITH {EV}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY time) - 1) // 5 AS w FROM ev WHERE v IS NOT NULL) SELECT user_id, min(time) AS time, max(time) AS end_time, round(sum(v), 4) AS total FROM n GROUP BY user_id, w HAVING count(*) = 5")
def window_count(spark, d):
    return W.group_by_count(events(spark, d), F.col("v"), 5, [r(F.sum("v")).alias("total")], ["user_id"])


@query(f"WITH {EV}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER o AND row_number() OVER o > 1 THEN 1 ELSE 0 END AS n FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY time) AS w FROM c) SELECT user_id, min(time) AS time, max(time) AS end_time, count(*) AS rows FROM g GROUP BY user_id, w")
def window_variation_equal(spark, d):
    return W.group_by_variation(events(spark, d), "event_type", 0, [F.count("*").alias("rows")], ["user_id"])


@query(f"WITH RECURSIVE {EV}, n AS (SELECT user_id, time, value, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i FROM ev), f AS (SELECT user_id, time, value, i, value AS head, 0 AS w FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.time, n.value, n.i, CASE WHEN abs(n.value - f.head) > 30 THEN n.value ELSE f.head END, CASE WHEN abs(n.value - f.head) > 30 THEN f.w + 1 ELSE f.w END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT user_id, min(time) AS time, max(time) AS end_time, count(*) AS rows FROM f GROUP BY user_id, w")
def window_variation_delta(spark, d):
    return W.group_by_variation(events(spark, d), "value", 30, [F.count("*").alias("rows")], ["user_id"], columns=[])


# fill


GRID = f"""t AS (SELECT DISTINCT event_type FROM ev), k AS (SELECT event_type, unnest(range(0, 720)) AS k FROM t),
a AS (SELECT event_type, (time - {S}) // {HOUR} AS k, max(v) AS high, count(v) AS n FROM ev WHERE time >= {S} AND time < {E} GROUP BY 1, 2),
grid AS (SELECT k.event_type, {S} + k.k * {HOUR} AS time, high, CASE WHEN n > 0 THEN n END AS n FROM k LEFT JOIN a USING (event_type, k))"""


def _grid(spark, d):
    return W.group_by_time(events(spark, d), START, END, "1h", [F.max("v").alias("high"), F.when(F.count("v") > 0, F.count("v")).alias("n")], by=["event_type"])


@query(f"WITH {EV}, {GRID} SELECT event_type, time, n, last_value(high IGNORE NULLS) OVER (ORDER BY event_type, time) AS high FROM grid")
def fill_previous(spark, d):
    return FI.fill_previous(_grid(spark, d), ["high"], [F.col("event_type"), F.col("time")], block="event_type")


@query(f"WITH {EV}, {GRID} SELECT event_type, time, n, last_value(high IGNORE NULLS) OVER (ORDER BY event_type DESC, time DESC) AS high FROM grid")
def fill_previous_desc(spark, d):
    return FI.fill_previous(_grid(spark, d), ["high"], [F.col("event_type").desc(), F.col("time").desc()], block="event_type")


@query(f"WITH {EV}, {GRID}, x AS (SELECT *, last_value(high IGNORE NULLS) OVER o AS p, last_value(CASE WHEN high IS NOT NULL THEN time END IGNORE NULLS) OVER o AS q FROM grid WINDOW o AS (PARTITION BY event_type ORDER BY time)) SELECT event_type, time, n, CASE WHEN time - q <= {2 * HOUR} THEN p END AS high FROM x")
def fill_previous_threshold(spark, d):
    return FI.fill_previous(_grid(spark, d), ["high"], [F.col("time")], by=["event_type"], limit="2h")


@query(f"WITH {EV}, {GRID}, x AS (SELECT *, last_value(high IGNORE NULLS) OVER a AS p, first_value(high IGNORE NULLS) OVER b AS q, last_value(n IGNORE NULLS) OVER a + first_value(n IGNORE NULLS) OVER b AS m FROM grid WINDOW a AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_type, time, coalesce(n, m // 2) AS n, coalesce(high, (p + q) / 2) AS high FROM x")
def fill_linear_midpoint(spark, d):
    return FI.fill_linear(_grid(spark, d), ["high", "n"], [F.col("time")], by=["event_type"])


@query(f"WITH {EV}, {GRID} SELECT event_type, time, coalesce(n, 7) AS n, coalesce(high, 7) AS high FROM grid")
def fill_constant(spark, d):
    return FI.fill_constant(_grid(spark, d), ["high", "n"], 7)


# shape


@query(f"WITH {EV}, x AS (SELECT user_id, max(time) FILTER (v IS NOT NULL) AS tv, arg_max(v, time) FILTER (v IS NOT NULL) AS v, max(time) AS te, arg_max(event_type, time) AS e FROM ev GROUP BY user_id) SELECT tv AS time, user_id || '.v' AS timeseries, 'double' AS data_type, v AS value FROM x WHERE tv IS NOT NULL UNION ALL SELECT te, user_id || '.event_id', 'bigint', i FROM (SELECT user_id, max(time) AS te, arg_max(event_id, time) AS i FROM ev GROUP BY user_id)")
def last_query(spark, d):
    got = SH.last_query(events(spark, d).withColumn("user_id", F.col("user_id").cast("string")), "user_id", ["v", "event_id"])
    return got.withColumn("value", F.col("value").cast("double"))


@query(f"WITH {EV} SELECT 'a' AS device, time, v, NULL::BIGINT AS user_id FROM ev WHERE event_type = 'click' UNION ALL SELECT 'b', time, NULL, user_id FROM ev WHERE event_type = 'purchase'")
def align_by_device(spark, d):
    e = events(spark, d)
    return SH.align_by_device({"a": e.where("event_type = 'click'").select("time", "v"), "b": e.where("event_type = 'purchase'").select("time", "user_id")})


@query(f"WITH {EV}, {DAILY} SELECT coalesce(a.time, b.time) AS time, round(a.value, 4) AS click, round(b.value, 4) AS purchase FROM (SELECT * FROM daily WHERE event_type = 'click' AND time < {S + 20 * DAY}) a FULL JOIN (SELECT * FROM daily WHERE event_type = 'purchase' AND time > {S + 5 * DAY}) b ON a.time = b.time")
def time_join(spark, d):
    x = rounded(daily(spark, d), "value")
    a = x.where(f"event_type = 'click' AND time < {S + 20 * DAY}").select("time", F.col("value").alias("click"))
    b = x.where(f"event_type = 'purchase' AND time > {S + 5 * DAY}").select("time", F.col("value").alias("purchase"))
    return SH.time_join(a, b)


@query(f"WITH {EV}, {DAILY} SELECT time, round(max(value) FILTER (event_type = 'click'), 4) AS click, round(max(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM daily GROUP BY time")
def narrow_to_wide(spark, d):
    return rounded(to_wide(daily(spark, d).withColumnRenamed("event_type", "series"), ["click", "purchase"]), "click", "purchase")


@query("SELECT l_orderkey AS device, epoch_us(l_shipdate) + l_linenumber AS time, m AS measurement, x AS value FROM (SELECT l_orderkey, l_shipdate, l_linenumber, unnest(['l_quantity', 'l_tax']) AS m, unnest([l_quantity, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END]) AS x FROM lineitem) WHERE x IS NOT NULL")
def wide_to_narrow(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("device"), (micros(F.col("l_shipdate")) + F.col("l_linenumber")).alias("time"), "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))
    return to_long(li, ["l_quantity", "l_tax"])


@query("SELECT 'root.' || (user_id % 7) || '.*.' || event_type AS path, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def group_by_level(spark, d):
    path = F.concat(F.lit("root."), F.col("user_id") % 7, F.lit(".u"), F.col("user_id"), F.lit("."), F.col("event_type"))
    return SH.group_by_level(events(spark, d).withColumn("path", path), "path", [1], [F.count("*").alias("n"), F.max("value").alias("high")])


@query("SELECT n_name AS nation, r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def group_by_tags(spark, d):
    c, n, g = (table(spark, d, t) for t in ("customer", "nation", "region"))
    catalog = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).select(F.col("c_custkey").alias("o_custkey"), F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name").alias("tags"))
    return SH.group_by_tags(table(spark, d, "orders"), catalog, "o_custkey", ["nation", "region"], [F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")])


@query(f"WITH {EV} SELECT event_id, time FROM ev ORDER BY time DESC, event_id LIMIT 25 OFFSET 10")
def limit_offset(spark, d):
    return SH.page(events(spark, d).select("event_id", "time"), [F.col("time").desc(), F.col("event_id")], 25, 10)


@query(f"WITH {EV} SELECT time, event_id, v FROM ev")
def series_limit(spark, d):
    return SH.series_page(events(spark, d), ["value", "event_id", "v", "user_id"], 2, 1)


@query("SELECT DISTINCT 'root.' || event_type || '.u' || user_id AS path FROM events WHERE event_type LIKE 'c%'")
def path_pattern(spark, d):
    p = events(spark, d).select(F.concat(F.lit("root."), "event_type", F.lit(".u"), F.col("user_id")).alias("path")).distinct()
    return p.where(match_path(F.col("path"), "root.c*.**"))


@query("SELECT count(DISTINCT event_type) AS nodes FROM events")
def count_nodes(spark, d):
    p = events(spark, d).select(F.concat(F.lit("root."), "event_type", F.lit(".u"), F.col("user_id")).alias("path"))
    return SH.count_nodes(p, "path", 1)


# scalars


MATH_SQL = {"sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "asin": "asin(y)", "acos": "acos(y)", "atan": "atan(x)", "sinh": "sinh(y)", "cosh": "cosh(y)", "tanh": "tanh(x)", "exp": "exp(y)", "log": "ln(x)", "log10": "log10(x)", "sqrt": "sqrt(x)", "ceil": "ceil(x)::DOUBLE", "floor": "floor(x)::DOUBLE", "sign": "sign(x - 50)::DOUBLE", "degrees": "degrees(y)", "radians": "radians(x)", "abs": "abs(x - 50)"}


@query("SELECT event_id, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in MATH_SQL.items()) + " FROM (SELECT event_id, value + 1 AS x, value / 1000 AS y FROM events)")
def math_all(spark, d):
    x, y = F.col("value") + 1, F.col("value") / 1000
    arg = {"asin": y, "acos": y, "sinh": y, "cosh": y, "exp": y, "degrees": y, "sign": x - 50, "abs": x - 50}
    return events(spark, d).select("event_id", *[r(SC.MATH[n](arg.get(n, x)), 6).alias(n) for n in MATH_SQL])


@query("SELECT event_id, contains(event_type, 'c') AS has, regexp_full_match(event_type, 'c.*k') AS whole, upper(event_type) AS up, trim('  ' || event_type || ' ') AS cut, value BETWEEN 10 AND 50 AS inside, value >= 30 AS onoff, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS kind, replace(event_type, 'c', 'xy') AS rep, substring(event_type, 2, 3) AS sub, round(value, 1) AS r1, CAST(floor(value) AS INT) AS i FROM events")
def string_and_predicate_functions(spark, d):
    t, v = F.col("event_type"), F.col("value")
    return events(spark, d).select("event_id", SC.string_contains(t, "c").alias("has"), SC.string_matches(t, "c.*k").alias("whole"), F.upper(t).alias("up"), SC.trim(F.concat(F.lit("  "), t, F.lit(" "))).alias("cut"), SC.in_range(v, 10, 50).alias("inside"), SC.on_off(v, 30).alias("onoff"), F.when(v > 100, "high").otherwise("low").alias("kind"), F.replace(t, F.lit("c"), F.lit("xy")).alias("rep"), F.substring(t, 2, 3).alias("sub"), F.round(v, 1).alias("r1"), F.floor(v).cast("int").alias("i"))


@query("SELECT page_id, regexp_extract(url, '[0-9]+') AS num, regexp_replace(url, '[0-9]', '#', 'g') AS masked, len(string_split(url, '/')) AS parts, string_split(url, '/')[3] AS host FROM pages WHERE regexp_matches(url, '[0-9]+') AND NOT suffix(url, '/')")
def regex_functions(spark, d):
    u = F.col("url")
    p = table(spark, d, "pages").where(SC.regex_match(u, "[0-9]+").isNotNull() & ~u.endswith("/"))
    return p.select("page_id", SC.regex_match(u, "[0-9]+").alias("num"), SC.regex_replace(u, "[0-9]", "#").alias("masked"), SC.regex_split(u, "/").cast("long").alias("parts"), SC.regex_split(u, "/", 2).alias("host"))


# series


U = ["user_id"]


@query(f"WITH {EV} SELECT user_id, time, v - last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS diff FROM ev")
def diff(spark, d):
    return SE.diff(events(spark, d), "v", U)


@query(f"WITH {EV}, x AS (SELECT user_id, time, (value - lag(value) OVER o) / ((time - lag(time) OVER o) / 1000000) AS derivative FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time)) SELECT user_id, time, round(derivative, 6) AS derivative FROM x WHERE derivative IS NOT NULL")
def derivative(spark, d):
    return rounded(SE.derivative(events(spark, d), "value", U), "derivative", n=6)


@query(f"WITH {EV}, x AS (SELECT user_id, time, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY time) AS p FROM ev) SELECT user_id, time, event_type FROM x WHERE p IS NULL OR p <> event_type")
def change_points(spark, d):
    return SE.change_points(events(spark, d), "event_type", U)


@query(f"WITH {EV} SELECT user_id, time, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, time) <= 3")
def top_k(spark, d):
    return SE.top_k(events(spark, d), "value", 3, U)


@query(f"WITH {EV} SELECT user_id, time, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, time) <= 3")
def bottom_k(spark, d):
    return SE.bottom_k(events(spark, d), "value", 3, U)


@query(f"WITH {EV}, g AS (SELECT user_id, time, v IS NULL AS z, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY time) AS k FROM ev) SELECT user_id, min(time) AS time, count(*) AS count, max(time) - min(time) AS duration FROM g WHERE z GROUP BY user_id, k")
def zero_runs(spark, d):
    return SE.zero_runs(events(spark, d).withColumn("z", F.coalesce("v", F.lit(0.0))), "z", U)


@query(f"""WITH {EV}, g AS (SELECT event_type, (time - {S}) // {DAY} AS k, min((time, value)) AS f, max((time, value)) AS l, min((value, time)) AS b, max((value, -time)) AS h FROM ev WHERE time >= {S} AND time < {E} GROUP BY 1, 2),
p AS (SELECT event_type, f[1] AS time, f[2] AS value FROM g UNION SELECT event_type, b[2], b[1] FROM g WHERE b[2] <> f[1] AND b[1] <> l[2] UNION SELECT event_type, -h[2], h[1] FROM g WHERE -h[2] <> f[1] AND h[1] <> l[2] UNION SELECT event_type, l[1], l[2] FROM g) SELECT * FROM p""")
def m4(spark, d):
    return SE.m4(events(spark, d), "value", "1d", S, E, ["event_type"])


@query(f"WITH {EV} SELECT user_id, time, round(a, 4) AS mvavg FROM (SELECT user_id, time, avg(value) OVER o AS a, count(value) OVER o AS n FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5")
def mvavg(spark, d):
    return rounded(SE.moving_average(events(spark, d), "value", 5, U), "mvavg")


@query(f"WITH {EV} SELECT user_id, time, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 4) AS zscore FROM ev WINDOW w AS (PARTITION BY user_id)")
def zscore(spark, d):
    return rounded(SE.zscore(events(spark, d), "value", U), "zscore")


@query(f"WITH {EV}, b AS (SELECT user_id, min(value) AS l, max(value) AS h FROM ev GROUP BY user_id) SELECT user_id, time, round((value - l) / (h - l), 6) AS minmax FROM ev JOIN b USING (user_id) WHERE h > l")
def minmax(spark, d):
    return rounded(SE.minmax(events(spark, d), "value", U), "minmax", n=6)


@query(f"WITH {EV}, t AS (SELECT DISTINCT event_type, unnest(range(0, 8))::INT AS bucket FROM ev), c AS (SELECT event_type, least(greatest(floor((value - 10) / 25.0), 0), 7)::INT AS bucket, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_type, bucket, coalesce(n, 0) AS n FROM t LEFT JOIN c USING (event_type, bucket)")
def histogram(spark, d):
    return SE.histogram(events(spark, d), "value", 10, 210, 8, ["event_type"])


TRAP = "x AS (SELECT user_id, time, value, (value + lag(value) OVER o) * (time - lag(time) OVER o) / 2 AS a FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time))"


@query(f"WITH {EV}, {TRAP}, i AS (SELECT user_id, coalesce(sum(a), 0) / 60000000 AS i, sum(a) / nullif(max(time) - min(time), 0) AS m, any_value(value) AS v FROM x GROUP BY user_id) SELECT user_id, round(i, 2) AS integral, round(coalesce(m, v), 4) AS integralavg FROM i")
def integral(spark, d):
    e = events(spark, d)
    return rounded(rounded(SE.integral(e, "value", U, unit="1m"), "integral", n=2).join(SE.integral_avg(e, "value", U), U), "integralavg")


@query(f"WITH {EV}, m AS (SELECT event_type, avg(value) AS a FROM ev GROUP BY 1) SELECT event_type, round(avg((value - a) ^ 3) / avg((value - a) ^ 2) ^ 1.5, 4) AS skew FROM ev JOIN m USING (event_type) GROUP BY event_type")
def skew(spark, d):
    return rounded(SE.skew(events(spark, d), "value", ["event_type"]), "skew")


@query(f"WITH {EV}, m AS (SELECT user_id, median(value) AS median FROM ev GROUP BY 1) SELECT user_id, any_value(round(median, 6)) AS median, round(median(abs(value - median)), 6) AS mad FROM ev JOIN m USING (user_id) GROUP BY user_id")
def median_mad(spark, d):
    e = events(spark, d)
    return rounded(SE.median(e, "value", U).join(SE.mad(e, "value", U), U), "median", "mad", n=6)


@query(f"WITH {EV}, n AS (SELECT user_id, time, value, row_number() OVER (PARTITION BY user_id ORDER BY value, time) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, time, value FROM n WHERE i = least(ceil(n * 0.9), n - 1)")
def percentile(spark, d):
    return SE.percentile(events(spark, d), "value", 0.9, U)


@query(f"WITH {EV}, q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM ev GROUP BY 1) SELECT user_id, time, value FROM ev JOIN q USING (user_id) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def iqr(spark, d):
    return SE.iqr(events(spark, d), "value", U)


@query(f"WITH {EV}, n AS (SELECT user_id, time, value, row_number() OVER o AS i, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY time), w AS (PARTITION BY user_id ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), f AS (SELECT user_id, a AS fa, s AS fs FROM n WHERE i = 20) SELECT user_id, time, value FROM n JOIN f USING (user_id) WHERE abs(value - CASE WHEN i <= 20 THEN fa ELSE a END) > 2.5 * CASE WHEN i <= 20 THEN fs ELSE s END")
def ksigma(spark, d):
    return SE.ksigma(events(spark, d), "value", 2.5, 20, U)


@query(f"WITH {EV} SELECT user_id, time, value FROM ev WHERE value < 5 OR value > 150")
def out_of_range(spark, d):
    return SE.out_of_range(events(spark, d), "value", 5, 150, U)


@query("SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 2) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1")
def cov_pearson(spark, d):
    li, k = table(spark, d, "lineitem"), ["l_returnflag"]
    a, b = SE.cov(li, "l_quantity", "l_extendedprice", k), SE.pearson(li, "l_quantity", "l_extendedprice", k)
    return a.join(b, k).select(*k, r("cov", 2).alias("cov"), r("pearson", 6).alias("pearson"))


CONS = "p AS (SELECT event_type, time, row_number() OVER (PARTITION BY event_type ORDER BY time) AS i FROM grid WHERE high IS NOT NULL), q AS (SELECT event_type, time, time - i * 3600000000 AS g FROM p), s AS (SELECT event_type, min(time) AS time, count(*) AS length FROM q GROUP BY event_type, g)"


@query(f"WITH {EV}, {GRID}, {CONS} SELECT event_type, time, length FROM s WHERE length > 1")
def consecutive_sequences(spark, d):
    return SE.consecutive_sequences(_grid(spark, d), ["high"], "1h", ["event_type"])


@query(f"WITH {EV}, {GRID}, {CONS} SELECT event_type, unnest(range(time, time + (length - 3) * {HOUR} + 1, {HOUR})) AS time, 3 AS length FROM s WHERE length >= 3")
def consecutive_windows(spark, d):
    return SE.consecutive_windows(_grid(spark, d), ["high"], "1h", 3, ["event_type"])


@query(f"WITH {EV}, {GRID}, b AS (SELECT event_type, time, avg_v FROM (SELECT k.event_type, {S} + k.k * {HOUR} AS time, x.avg_v FROM k LEFT JOIN (SELECT event_type, (time - {S}) // {HOUR} AS k, avg(v) AS avg_v FROM ev WHERE v IS NOT NULL GROUP BY 1, 2) x USING (event_type, k))), n AS (SELECT *, last_value(CASE WHEN avg_v IS NOT NULL THEN time END IGNORE NULLS) OVER a AS ta, last_value(avg_v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN avg_v IS NOT NULL THEN time END IGNORE NULLS) OVER z AS tb, first_value(avg_v IGNORE NULLS) OVER z AS vb FROM b WINDOW a AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_type, time, round(coalesce(avg_v, va + (vb - va) * ((time - ta) / nullif(tb - ta, 0))), 6) AS value FROM n")
def resample(spark, d):
    return rounded(SE.resample(events(spark, d), "v", "1h", S, E, ["event_type"], interp="linear"), "value", n=6)


@query(f"WITH {EV}, n AS (SELECT user_id, time, v, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i FROM ev), x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, last_value(v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ib, first_value(v IGNORE NULLS) OVER z AS vb FROM n WINDOW a AS (PARTITION BY user_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, time, round(coalesce(v, CASE WHEN ib IS NULL THEN va WHEN coalesce(ia, 0) <= 1 THEN vb ELSE va + (vb - va) / (ib - ia) * (i - ia) END), 6) AS value FROM x")
def valuefill_linear(spark, d):
    e = events(spark, d).withColumn("x", F.coalesce("v", F.lit(float("nan"))))
    return rounded(SE.value_fill(e, "x", U), "value", n=6)


@query(f"WITH {EV}, n AS (SELECT user_id, time, value, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, time, value FROM n WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda k: k * n // 7), i)")
def sample_isometric(spark, d):
    return SE.sample_isometric(events(spark, d), "value", 7, U)


# series in numpy


DN = f"WITH {EV}, {DAILY}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY time) AS i FROM daily)"


@query(f"{DN}, p AS (SELECT a.event_type, a.i + b.i - 2 AS time, sum(a.value * b.value) AS value FROM s a JOIN s b USING (event_type) GROUP BY 1, 2) SELECT event_type, time, round(value, 2) AS value FROM p")
def conv(spark, d):
    x = daily(spark, d).withColumn("w", F.col("value"))
    return rounded(N.apply(x, N.conv, ["value", "w"], ["event_type"]), "value", n=2)


@query(f"{DN}, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.event_type, a.i - b.i AS k, sum(a.value * b.value) AS t FROM s a JOIN s b USING (event_type) GROUP BY 1, 2) SELECT event_type, n + k AS time, round(t / (n - abs(k)), 4) AS value FROM p JOIN n USING (event_type)")
def acf(spark, d):
    return rounded(N.apply(daily(spark, d), N.acf, "value", ["event_type"]), "value")


@query(f"WITH {EV} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS time, round(value, 6) AS value FROM ev")
def dwt_round_trip_events(spark, d):
    """Whole series of any length: the last value is repeated up to a power of two."""

    def both(t, v):
        padded = np.pad(v, (0, (1 << (len(v) - 1).bit_length()) - len(v)), "edge") if len(v) else v
        if len(padded) < 2:
            return range(len(v)), v
        return range(len(v)), N.idwt(t, N.dwt(t, padded, "db4", layer=2)[1], "db4", layer=2)[1][: len(v)]

    return rounded(N.apply(events(spark, d), both, "value", U), "value", n=6)


@query(f"WITH {EV}, {DAILY} SELECT event_type, time, round(value, 6) AS value FROM daily")
def fft_round_trip(spark, d):
    def both(t, v):
        return t, N.ifft(t, N.fft(t, v, "real")[1], N.fft(t, v, "imag")[1])[1]

    return rounded(N.apply(daily(spark, d), both, "value", ["event_type"]), "value", n=6)


@query(f"WITH RECURSIVE {EV}, {DAILY}, p AS (SELECT time, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'purchase') AS b FROM daily GROUP BY time), s AS (SELECT a, b, row_number() OVER (ORDER BY time) AS i FROM p WHERE a IS NOT NULL AND b IS NOT NULL), z AS (SELECT count(*)::INT AS n FROM s), l AS (SELECT list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM s), f AS (SELECT 1 AS i, list_transform(range(1, n + 1), lambda j: list_sum(list_transform(range(1, j + 1), lambda q: abs(l.a[1] - l.b[q])))) AS row FROM l, z UNION ALL SELECT f.i + 1, list_reduce(list_transform(range(1, n + 1), lambda j: [abs(l.a[f.i + 1] - l.b[j]), f.row[j], CASE WHEN j > 1 THEN f.row[j - 1] ELSE 1e300 END]), lambda acc, x: list_append(acc, x[1] + least(x[2], x[3], acc[len(acc)])), [1e300])[2:] FROM f, l, z WHERE f.i < n) SELECT 'all' AS device, 0::BIGINT AS time, round(row[n], 4) AS value FROM f, z WHERE f.i = n")
def dtw(spark, d):
    w = to_wide(daily(spark, d).withColumnRenamed("event_type", "series"), ["click", "purchase"]).withColumn("device", F.lit("all"))
    return rounded(N.apply(w, N.dtw, ["click", "purchase"], ["device"]), "value")


# writing


@query("SELECT user_id, event_type, arg_max(value, ts) AS value, epoch_us(max(ts)) AS time FROM events GROUP BY 1, 2")
def upsert_dedup(spark, d):
    return store.upsert(events(spark, d), ["user_id", "event_type"], "time").select("user_id", "event_type", "value", "time")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE NOT (event_type = 'click' AND time BETWEEN {S + DAY} AND {S + 9 * DAY}) AND NOT time BETWEEN {S + 20 * DAY} AND {S + 21 * DAY}")
def delete_range(spark, d):
    return store.delete_ranges(events(spark, d), [("click", S + DAY, S + 9 * DAY), (None, S + 20 * DAY, S + 21 * DAY)], "event_type").select("event_id")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE time >= {E - 7 * DAY}")
def ttl(spark, d):
    return store.within_ttl(events(spark, d, E - 7 * DAY), E, "7d").select("event_id")


# further queries register themselves
from . import more  # noqa: E402, F401
