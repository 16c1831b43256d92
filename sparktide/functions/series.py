"""Functions over series that windows and aggregates express.

Each takes rows with group columns ``by`` (one series per group), a long ``time`` and a value
column, and returns rows.  Series are partitioned by ``by``, so many series run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Duration
from . import numeric, repair


def _w(by: list[str], time: str = "time"):
    return Window.partitionBy(*by).orderBy(time)


def _points(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull())


def diff(df: DataFrame, value: str, by: list[str], time: str = "time", ignore_null: bool = True) -> DataFrame:
    """Value less the one before; null for the first row."""
    before = F.last(value, ignorenulls=True).over(_w(by, time).rowsBetween(Window.unboundedPreceding, -1)) if ignore_null else F.lag(value).over(_w(by, time))
    return df.select(*by, time, (F.col(value) - before).alias("diff"))


def difference(df: DataFrame, value: str, by: list[str], time: str = "time", absolute: bool = False) -> DataFrame:
    rows = diff(_points(df, value), value, by, time).where("diff is not null")
    return rows.withColumn("diff", F.abs("diff")) if absolute else rows


def derivative(df: DataFrame, value: str, by: list[str], time: str = "time", unit: int = 1_000_000, absolute: bool = False) -> DataFrame:
    """Change of the value in a unit of time; the first row has none."""
    w, v = _w(by, time), F.col(value).cast("double")
    d = (v - F.lag(v).over(w)) / ((F.col(time) - F.lag(time).over(w)) / unit)
    rows = _points(df, value).select(*by, time, (F.abs(d) if absolute else d).alias("derivative"))
    return rows.where("derivative is not null")


def change_points(df: DataFrame, value: str, by: list[str], time: str = "time") -> DataFrame:
    w = _w(by, time)
    rows = _points(df, value).withColumn("__p", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return rows.where((F.col("__n") == 1) | (F.col(value) != F.col("__p"))).select(*by, time, value)


def top_k(df: DataFrame, value: str, k: int, by: list[str], time: str = "time", largest: bool = True) -> DataFrame:
    """The k largest values (of equals the earlier), to be read in the order of time."""
    if not 0 < k <= 1000:
        raise ValueError("k must be in 1..1000")
    c = F.col(value).desc() if largest else F.col(value).asc()
    rows = _points(df, value).withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(c, time)))
    return rows.where(F.col("__n") <= k).select(*by, time, value)


def bottom_k(df: DataFrame, value: str, k: int, by: list[str], time: str = "time") -> DataFrame:
    return top_k(df, value, k, by, time, largest=False)


def value_runs(df: DataFrame, predicate: Column, by: list[str], time: str = "time") -> DataFrame:
    """Runs of true: (time of the first row, count, duration)."""
    rows = df.withColumn("__p", predicate).where("__p is not null")
    rows = rows.withColumn("__g", F.sum(F.when(F.col("__p"), 0).otherwise(1)).over(_w(by, time).rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("__p").groupBy(*by, "__g").agg(F.min(time).alias("time"), F.count("*").alias("count"), (F.max(time) - F.min(time)).alias("duration"))
    return out.drop("__g")


def zero_runs(df: DataFrame, value: str, by: list[str], time: str = "time", zero: bool = True) -> DataFrame:
    is_zero = ~F.col(value) if dict(df.dtypes)[value] == "boolean" else F.col(value) == 0
    return value_runs(df, is_zero if zero else ~is_zero, by, time)


def m4(df: DataFrame, value: str, interval, start: int, end: int, by: list[str], time: str = "time") -> DataFrame:
    """First, last, bottom and top point of each window, each row once.

    Bottom and top are left out when they are the first row or have the last row's value.
    """
    size = Duration(interval).micros
    rows = _points(df, value).where((F.col(time) >= start) & (F.col(time) < end))
    rows = rows.withColumn("__k", ((F.col(time) - start) - F.pmod(F.col(time) - start, F.lit(size))) / size)
    return _four(rows, value, by, time)


def _four(rows: DataFrame, value: str, by: list[str], time: str) -> DataFrame:
    p = F.struct(F.col(time).alias("time"), F.col(value).alias("value"))
    t, v = F.col(time), F.col(value)
    per = rows.groupBy(*by, "__k").agg(F.min_by(p, t).alias("f"), F.max_by(p, t).alias("l"), F.min_by(p, F.struct(v, t)).alias("b"), F.max_by(p, F.struct(v, -t)).alias("h"))
    extra = lambda c: F.when((F.col(f"{c}.time") != F.col("f.time")) & (F.col(f"{c}.value") != F.col("l.value")), F.col(c))
    last = F.when(F.col("l.time") != F.col("f.time"), F.col("l"))
    points = F.array_distinct(F.filter(F.array("f", extra("b"), extra("h"), last), lambda x: x.isNotNull()))
    return per.select(*by, F.explode(points).alias("x")).select(*by, "x.time", "x.value")


def m4_by_count(df: DataFrame, value: str, size: int, by: list[str], time: str = "time", step: int | None = None) -> DataFrame:
    """The same for windows of ``size`` rows every ``step`` rows; a point of several windows comes once for each."""
    step = step or size
    rows = _points(df, value).withColumn("__i", F.row_number().over(_w(by, time)) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("__i") - size) / step) + 1)
    rows = rows.withColumn("__k", F.explode(F.sequence(first.cast("long"), F.floor(F.col("__i") / step).cast("long"))))
    rows = rows.where(F.col("__i") < F.col("__k") * step + size)
    return _four(rows, value, by, time)


def moving_average(df: DataFrame, value: str, window: int, by: list[str], time: str = "time") -> DataFrame:
    """The mean of each ``window`` values in a row, at the last one's time."""
    w = _w(by, time).rowsBetween(-(window - 1), 0)
    rows = _points(df, value).select(*by, time, F.avg(value).over(w).alias("mvavg"), F.count(value).over(w).alias("__n"))
    return rows.where(F.col("__n") == window).drop("__n")


def zscore(df: DataFrame, value: str, by: list[str], time: str = "time", avg: float | None = None, sd: float | None = None) -> DataFrame:
    """Distance from the mean in population deviations; two aggregates meet the rows again."""
    rows = _points(df, value)
    if avg is None:
        rows = rows.join(rows.groupBy(*by).agg(F.avg(value).alias("__a"), F.stddev_pop(value).alias("__s")), by)
        return rows.select(*by, time, F.try_divide(F.col(value) - F.col("__a"), F.col("__s")).alias("zscore"))
    return rows.select(*by, time, ((F.col(value) - avg) / sd).alias("zscore"))


def minmax(df: DataFrame, value: str, by: list[str], time: str = "time", low: float | None = None, high: float | None = None) -> DataFrame:
    rows = _points(df, value)
    if low is None:
        rows = rows.join(rows.groupBy(*by).agg(F.min(value).alias("__l"), F.max(value).alias("__h")), by)
    else:
        rows = rows.withColumns({"__l": F.lit(low), "__h": F.lit(high)})
    return rows.where("__h > __l").select(*by, time, ((F.col(value) - F.col("__l")) / (F.col("__h") - F.col("__l"))).alias("minmax"))


def distinct(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return _points(df, value).select(*by, value).distinct()


def histogram(df: DataFrame, value: str, low: float, high: float, count: int, by: list[str]) -> DataFrame:
    """Counts of all buckets; values beyond the bounds belong to the outer ones."""
    k = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / count)), F.lit(0)), F.lit(count - 1)).cast("int")
    rows = _points(df, value).where(~F.isnan(value) & (F.abs(value) != float("inf")))
    got = rows.groupBy(*by, k.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bucket"))
    return every.join(got, [*by, "bucket"], "left").select(*by, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _trapezoids(df: DataFrame, value: str, by: list[str], time: str):
    rows = _points(df, value).where(~F.isnan(F.col(value).cast("double")))
    w, v = _w(by, time), F.col(value)
    return rows.withColumn("__a", (v + F.lag(v).over(w)) * (F.col(time) - F.lag(time).over(w)) / 2)


def integral(df: DataFrame, value: str, by: list[str], time: str = "time", unit="1s") -> DataFrame:
    return _trapezoids(df, value, by, time).groupBy(*by).agg((F.coalesce(F.sum("__a"), F.lit(0.0)) / Duration(unit).micros).alias("integral"))


def integral_avg(df: DataFrame, value: str, by: list[str], time: str = "time") -> DataFrame:
    """The integral over the time it spans; a single point is its own mean."""
    per = _trapezoids(df, value, by, time).groupBy(*by).agg(F.sum("__a").alias("a"), (F.max(time) - F.min(time)).alias("d"), F.min_by(value, time).alias("v"))
    return per.select(*by, F.when(F.col("d") > 0, F.col("a") / F.col("d")).otherwise(F.col("v")).alias("integralavg"))


def skew(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.skewness(value).alias("skew"))


def median(df: DataFrame, value: str, by: list[str], error: float = 0) -> DataFrame:
    m = F.percentile(value, 0.5) if error == 0 else F.percentile_approx(value, 0.5, int(1 / error))
    return df.groupBy(*by).agg(m.alias("median"))


def mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The median distance from the median, not scaled."""
    return df.join(median(df, value, by), by).groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))


def percentile(df: DataFrame, value: str, rank: float, by: list[str], time: str = "time") -> DataFrame:
    """The point at place ceil(n * rank), counted from 0, in the order of values; the last one beyond."""
    rows = _points(df, value).withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(value, time)) - 1)
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return rows.where(F.col("__i") == F.least(F.ceil(F.col("__n") * rank), F.col("__n") - 1)).select(*by, time, value)


def quantile(df: DataFrame, value: str, rank: float, by: list[str], accuracy: int = 800) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile_approx(value, rank, accuracy).alias("quantile"))


def iqr(df: DataFrame, value: str, by: list[str], time: str = "time", q1: float | None = None, q3: float | None = None) -> DataFrame:
    """Points beyond 1.5 interquartile ranges of the quartiles."""
    rows = _points(df, value)
    if q1 is None:
        quarts = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
        rows = rows.join(quarts, by).withColumns({"__a": F.col("__q")[0], "__b": F.col("__q")[1]})
    else:
        rows = rows.withColumns({"__a": F.lit(q1), "__b": F.lit(q3)})
    out = (F.col(value) < F.col("__a") - 1.5 * (F.col("__b") - F.col("__a"))) | (F.col(value) > F.col("__b") + 1.5 * (F.col("__b") - F.col("__a")))
    return rows.where(out).select(*by, time, value)


def ksigma(df: DataFrame, value: str, k: float, window: int, by: list[str], time: str = "time") -> DataFrame:
    """Points beyond k sample deviations of their window's mean.

    The first full window judges all its points; each later window its newest one.
    """
    w = _w(by, time)
    rows = _points(df, value).withColumn("__i", F.row_number().over(w))
    ring = w.rowsBetween(-(window - 1), 0)
    rows = rows.withColumns({"__a": F.avg(value).over(ring), "__s": F.stddev_samp(value).over(ring)})
    # the first full window's values for all rows of its series, in the same partitions
    whole, full = Window.partitionBy(*by), F.col("__i") == window
    rows = rows.withColumns({"__fa": F.max(F.when(full, F.col("__a"))).over(whole), "__fs": F.max(F.when(full, F.col("__s"))).over(whole)})
    early = F.col("__i") <= window
    a, s = F.when(early, F.col("__fa")).otherwise(F.col("__a")), F.when(early, F.col("__fs")).otherwise(F.col("__s"))
    return rows.where(F.abs(F.col(value) - a) > k * s).select(*by, time, value)


def out_of_range(df: DataFrame, value: str, low: float, high: float, by: list[str], time: str = "time") -> DataFrame:
    return df.where((F.col(value) < low) | (F.col(value) > high)).select(*by, time, value)


def cov(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.covar_pop(x, y), F.lit(float("nan"))).alias("cov"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.corr(x, y), F.lit(float("nan"))).alias("pearson"))


#: Rows of a series whose steps decide its gap.
PROBE = 128


def usual_gap(df: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """The most frequent step among the first rows of each series, the shortest of equals."""
    w = _w(by, time)
    steps = df.select(*by, (F.col(time) - F.lag(time).over(w)).alias("gap"), F.row_number().over(w).alias("__i")).where((F.col("__i") <= PROBE) & F.col("gap").isNotNull())
    counts = steps.groupBy(*by, "gap").agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.max_by("gap", F.struct("__n", -F.col("gap"))).alias("gap"))


def consecutive(df: DataFrame, values: list[str], gap, by: list[str], time: str = "time") -> DataFrame:
    """Rows without nulls in runs at steps of ``gap`` (``usual_gap`` if it is None), with the run's number and ``gap``."""
    full = F.lit(True)
    for v in values:
        full &= F.col(v).isNotNull()
    df = df.withColumn("gap", F.lit(Duration(gap).micros)) if gap is not None else df.join(usual_gap(df, by, time), by)
    rows, w = df.where(full), _w(by, time)
    new = F.when(F.col(time) - F.lag(time).over(w) == F.col("gap"), 0).otherwise(1)
    return rows.withColumn("__n", new).withColumn("run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def consecutive_sequences(df: DataFrame, values: list[str], gap, by: list[str], time: str = "time") -> DataFrame:
    out = consecutive(df, values, gap, by, time).groupBy(*by, "run").agg(F.min(time).alias("time"), F.count("*").alias("length"))
    return out.where("length > 1").drop("run")


def consecutive_windows(df: DataFrame, values: list[str], gap, length: int, by: list[str], time: str = "time") -> DataFrame:
    """First times of all windows of ``length`` rows that lie in one run."""
    seq = consecutive(df, values, gap, by, time).groupBy(*by, "run").agg(F.min(time).alias("__t"), F.max("gap").alias("__g"), F.count("*").alias("__n")).where(F.col("__n") >= length)
    starts = F.sequence(F.lit(0).cast("long"), F.col("__n") - length)
    return seq.select(*by, F.explode(F.transform(starts, lambda i: F.col("__t") + i * F.col("__g"))).alias("time"), F.lit(length).alias("length"))


def resample(df: DataFrame, value: str, every, start: int, end: int, by: list[str], time: str = "time", aggr: str = "mean", interp: str = "nan") -> DataFrame:
    """One value for each step of [start, end); steps without one are filled as ``interp`` says."""
    from ..operators.windows import group_by_time

    p = F.col(value)
    agg = {"mean": F.avg(p), "min": F.min(p), "max": F.max(p), "median": F.percentile(p, 0.5), "first": F.min_by(p, time), "last": F.max_by(p, time)}[aggr]
    grid = group_by_time(_points(df, value), start, end, every, [agg.alias("value")], by=by, time=time)
    back, ahead = _w(by).rowsBetween(Window.unboundedPreceding, 0), _w(by).rowsBetween(0, Window.unboundedFollowing)
    have = F.when(F.col("value").isNotNull(), F.struct("time", "value"))
    a, b = F.last(have, ignorenulls=True).over(back), F.first(have, ignorenulls=True).over(ahead)
    if interp == "nan":
        return grid
    if interp == "ffill":
        return grid.withColumn("value", a["value"])
    if interp == "bfill":
        return grid.withColumn("value", b["value"])
    line = a["value"] + (b["value"] - a["value"]) * F.try_divide(F.col("time") - a["time"], b["time"] - a["time"])
    return grid.withColumn("value", F.coalesce(F.col("value"), line))


def value_fill(df: DataFrame, value: str, by: list[str], time: str = "time", method: str = "linear") -> DataFrame:
    """NaN replaced: by the value before, the mean, or a line over row numbers (the last value after the end).

    Further methods (``repair.FILLS``) follow each series in one task.
    """
    if method in repair.FILLS:
        return numeric.apply(df, repair.FILLS[method], value, by, time)
    if method not in ("linear", "mean", "previous"):
        raise ValueError(f"no such method of filling: {method}")
    w = _w(by, time)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(~F.isnan(value), F.col(value)))
    if method == "mean":
        return rows.join(rows.groupBy(*by).agg(F.avg("__v").alias("__m")), by).select(*by, time, F.coalesce("__v", "__m").alias("value"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    if method == "previous":
        return rows.select(*by, time, F.coalesce(F.last("__v", ignorenulls=True).over(back), F.lit(float("nan"))).alias("value"))
    have = F.when(F.col("__v").isNotNull(), F.struct("__i", "__v"))
    rows = rows.withColumns({"__a": F.last(have, ignorenulls=True).over(back), "__b": F.first(have, ignorenulls=True).over(ahead)})
    slope = F.try_divide(F.col("__b.__v") - F.col("__a.__v"), F.col("__b.__i") - F.col("__a.__i"))
    # a gap whose left end is the first row (or none) has no slope and takes its right end's value
    flat = F.coalesce(F.col("__a.__i"), F.lit(0)) <= 1
    line = F.when(F.col("__b").isNull(), F.col("__a.__v")).when(flat, F.col("__b.__v")).otherwise(F.col("__a.__v") + slope * (F.col("__i") - F.col("__a.__i")))
    return rows.select(*by, time, F.coalesce("__v", line).alias("value"))


def sample_isometric(df: DataFrame, value: str, k: int, by: list[str], time: str = "time") -> DataFrame:
    """Points at places floor(i * n / k)."""
    rows = _points(df, value).withColumn("__i", F.row_number().over(_w(by, time)) - 1)
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    places = F.when(F.col("__n") <= k, F.array(F.col("__i").cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("__n") / k)))
    return rows.where(F.array_contains(places, F.col("__i").cast("long"))).select(*by, time, value)


def sample_reservoir(df: DataFrame, value: str, k: int, by: list[str], time: str = "time", seed: int = 0) -> DataFrame:
    """k points of each series, every choice as likely."""
    rows = _points(df, value).withColumn("__r", F.rand(seed))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__r"))).where(F.col("__n") <= k).select(*by, time, value)
