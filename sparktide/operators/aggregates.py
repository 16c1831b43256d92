"""Aggregates of series.  Each is a column for ``agg``; ties and types are part of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count(v):
    return F.count(_c(v))


def count_time(time, *values):
    """Times at which any of the values is there."""
    return F.count_distinct(F.when(F.coalesce(*[_c(v).isNotNull() for v in values]) if len(values) == 1 else F.greatest(*[_c(v).isNotNull() for v in values]), _c(time)))


def sum_(v):
    return F.sum(_c(v).cast("double"))


def avg(v):
    return F.avg(_c(v).cast("double"))


def min_time(v, time="time"):
    return F.min(F.when(_c(v).isNotNull(), _c(time)))


def max_time(v, time="time"):
    return F.max(F.when(_c(v).isNotNull(), _c(time)))


def first_value(v, time="time"):
    return F.min_by(_c(v), F.when(_c(v).isNotNull(), _c(time)))


def last_value(v, time="time"):
    return F.max_by(_c(v), F.when(_c(v).isNotNull(), _c(time)))


def extreme(v):
    """The value of the largest magnitude; of +x and -x the positive one."""
    c = _c(v)
    return F.max_by(c, F.when(c.isNotNull(), F.struct(F.abs(c), c)))


def max_by(x, y, time="time"):
    """x where y is largest, the earliest of equals."""
    return F.max_by(_c(x), F.when(_c(y).isNotNull(), F.struct(_c(y), -_c(time))))


def min_by(x, y, time="time"):
    return F.min_by(_c(x), F.when(_c(y).isNotNull(), F.struct(_c(y), _c(time))))


def time_duration(v, time="time"):
    return max_time(v, time) - min_time(v, time)


def stddev(v):
    return F.stddev_samp(_c(v))


def stddev_pop(v):
    return F.stddev_pop(_c(v))


def variance(v):
    return F.var_samp(_c(v))


def var_pop(v):
    return F.var_pop(_c(v))


def spread(v):
    return F.max(_c(v)) - F.min(_c(v))


def mode(df: DataFrame, value: str, by: list[str], time: str = "time", limit: int | None = None) -> DataFrame:
    """The most frequent value, of equals the one seen first; an error above ``limit`` distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(time).alias("t"))
    out = counts.groupBy(*by).agg(F.max_by(F.col(value), F.struct("n", -F.col("t"))).alias("mode"), F.count("*").alias("distinct"))
    if limit is not None:
        out = out.withColumn("mode", F.when(F.col("distinct") > limit, F.raise_error(F.lit("too many distinct values for mode"))).otherwise(F.col("mode")))
    return out.drop("distinct")


def runs(df: DataFrame, predicate: Column, by: list[str], time: str = "time", ignore_null: bool = True) -> DataFrame:
    """Rows of maximal runs of true, with ``run``: the number of rows before that broke a run."""
    w = Window.partitionBy(*by).orderBy(time)
    rows = df.withColumn("__p", predicate)
    rows = rows.where("__p is not null") if ignore_null else rows.withColumn("__p", F.coalesce("__p", F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("__p"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__p").drop("__p")


def keep_test(n: Column, keep: int | str) -> Column:
    """``3`` is ``keep>=3``; else a comparison such as ``keep<3``."""
    return n >= keep if isinstance(keep, int) else F.expr(keep.replace("keep", "__n"))


def count_if(df: DataFrame, predicate: Column, keep: int | str, by: list[str], time: str = "time", ignore_null: bool = True) -> DataFrame:
    """The number of maximal runs of true whose length satisfies ``keep``; 0 for groups without any."""
    each = runs(df, predicate, by, time, ignore_null).groupBy(*by, "run").agg(F.count("*").alias("__n"))
    found = each.where(keep_test(F.col("__n"), keep)).groupBy(*by).agg(F.count("*").alias("n"))
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("count_if"))
