"""GROUP BY windows: by time, session, condition, count and variation.

Time windows are numbered by arithmetic, so rows meet their window without a join; empty
windows come from the distinct groups, each with the sequence of all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EPOCH, Duration, instant
from .aggregates import keep_test, runs


#: The mean month of the calendar, in microseconds.
MONTH = int(30.436875 * 86_400_000_000)
DAY = 86_400_000_000


def calendar_point(start: int, months: Column, more: Column) -> Column:
    """``start`` plus months plus microseconds; the day is that of ``start`` where the month has it."""
    date = EPOCH + timedelta(microseconds=start)
    month = F.lit(date.year * 12 + date.month - 1) + months
    first = F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    day = F.least(F.date_add(first, date.day - 1), F.last_day(first))
    return F.datediff(day, F.lit(EPOCH.date())).cast("long") * DAY + start % DAY + more


def calendar_number(t: Column, start: int, step: Duration) -> Column:
    """How many steps from ``start`` on the last edge at or before ``t`` is; months vary by less than a step."""
    guess = F.floor((t - start) / (step.months * MONTH + step.micros)).cast("long")
    return F.array_max(F.filter(F.sequence(guess - 1, guess + 1), lambda k: calendar_point(start, k * step.months, k * step.micros) <= t))


def _steps(start: int, end: int, step: Duration) -> int:
    """How many calendar edges lie before ``end``."""
    low, high = 0, max(1, (end - start) // (step.months * 28 * DAY + step.micros) + 2)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if step.after(start, middle) < end else (low, middle)
    return low


def group_by_time(df: DataFrame, start, end, interval, aggs: list[Column], step=None, by: list[str] | None = None, time: str = "time", left_open: bool = False, zero: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over [start, end) (or (start, end]) in windows of ``interval`` every ``step``.

    Every window of every group comes out, with null aggregates where nothing is in it (0 for
    those named in ``zero``).  ``time`` is the left edge, or the right one if ``left_open``;
    windows end at ``end`` at the latest.
    """
    by, start, end = by or [], instant(start), instant(end)
    interval = Duration(interval)
    step = Duration(step) if step is not None else interval
    t = F.col(time)
    inside = (t > start) & (t <= end) if left_open else (t >= start) & (t < end)
    rows = df.where(inside)
    if interval.months or step.months:
        n = _steps(start, end, step)
        if not step.months:
            k = F.floor((t - start - (1 if left_open else 0)) / step.micros).cast("long")
        else:
            k = calendar_number(t - 1 if left_open else t, start, step)
        edge = lambda k: calendar_point(start, k * step.months, k * step.micros)
        stop = lambda k: F.least(F.lit(end), calendar_point(start, k * step.months + interval.months, k * step.micros + interval.micros))
        # windows that begin at or before the row, as far back as the longest one reaches
        reach = 1 if (interval.months, interval.micros) == (step.months, step.micros) else (interval.months * 31 * DAY + interval.micros) // (step.months * 28 * DAY + step.micros) + 1
        rows = rows.withColumn("__k", k)
        if reach > 1:
            rows = rows.withColumn("__k", F.explode(F.sequence(F.greatest(F.col("__k") - reach + 1, F.lit(0).cast("long")), F.col("__k"))))
        rows = rows.where(t <= stop(F.col("__k")) if left_open else t < stop(F.col("__k")))
        label = stop(F.col("__k")) if left_open else edge(F.col("__k"))
    else:
        n = max(0, -(-(end - start) // step.micros))
        offset = t - start - (1 if left_open else 0)
        k = (offset - F.pmod(offset, F.lit(step.micros))) / step.micros
        k = F.round(k).cast("long")
        if interval.micros <= step.micros:
            rows = rows.withColumn("__k", k)
            if interval.micros < step.micros:
                rows = rows.where(F.pmod(offset, F.lit(step.micros)) < interval.micros)
        else:
            low = F.greatest(F.lit(0), F.floor((offset - interval.micros) / step.micros).cast("long") + 1)
            rows = rows.withColumn("__k", F.explode(F.sequence(low, k)))
        label = F.least(F.lit(end), start + F.col("__k") * step.micros + interval.micros) if left_open else start + F.col("__k") * step.micros
    got = rows.groupBy(*by, "__k").agg(*aggs)
    if n <= 0:
        return got.limit(0).withColumn("__k", label).withColumnRenamed("__k", "time")
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("__k"))
    out = every.join(got, [*by, "__k"], "left").withColumn("__time", label).drop("__k")
    names = [c for c in got.columns if c not in (*by, "__k")]
    return out.select(*by, F.col("__time").cast("long").alias("time"), *[F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.col(c) for c in names])


def group_by_filter(time: Column, start, end, interval, step) -> Column:
    """Rows that lie in any window: half-open, modulo the step; months count from the original start."""
    s, size, p = instant(start), Duration(interval), Duration(step)
    inside = (time >= s) & (time < instant(end))
    if not p.months and not size.months:
        return inside & (F.pmod(time - s, F.lit(p.micros)) < size.micros)
    k = calendar_number(time, s, p) if p.months else F.floor((time - s) / p.micros).cast("long")
    return inside & (time < calendar_point(s, k * p.months + size.months, k * p.micros + size.micros))


def _finish(rows: DataFrame, by: list[str], number: str, aggs: list[Column], time: str) -> DataFrame:
    """Row windows: ``time`` and ``end_time`` are those of the first and last row."""
    return rows.groupBy(*by, number).agg(F.min(time).alias("__start"), F.max(time).alias("end_time"), *aggs).drop(number).withColumnRenamed("__start", "time")


def group_by_session(df: DataFrame, gap, aggs: list[Column], by: list[str], time: str = "time") -> DataFrame:
    """A new window where the step from the row before is *greater* than ``gap``."""
    w = Window.partitionBy(*by).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) > Duration(gap).micros, 1).otherwise(0)
    rows = df.withColumn("__n", new).withColumn("__w", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _finish(rows, by, "__w", aggs, time)


def group_by_condition(df: DataFrame, predicate: Column, keep: int | str, aggs: list[Column], by: list[str], time: str = "time", ignore_null: bool = True) -> DataFrame:
    """Maximal runs of true whose number of rows satisfies ``keep``; null neither breaks nor counts."""
    rows = runs(df, predicate, by, time, ignore_null)
    out = rows.groupBy(*by, "run").agg(F.min(time).alias("__start"), F.max(time).alias("end_time"), F.count("*").alias("__n"), *aggs)
    return out.where(keep_test(F.col("__n"), keep)).drop("run", "__n").withColumnRenamed("__start", "time")


def group_by_count(df: DataFrame, control: Column, n: int, aggs: list[Column], by: list[str], time: str = "time", ignore_null: bool = True) -> DataFrame:
    """``n`` rows a window; an incomplete last window is dropped, rows without control value don't count."""
    rows = df.where(control.isNotNull()) if ignore_null else df
    rows = rows.withColumn("__w", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1) / n))
    out = rows.groupBy(*by, "__w").agg(F.min(time).alias("__start"), F.max(time).alias("end_time"), F.count("*").alias("__n"), *aggs)
    return out.where(F.col("__n") == n).drop("__w", "__n").withColumnRenamed("__start", "time")


def _numbered(v: np.ndarray, null: np.ndarray, delta: float, number: int, head: float | None) -> tuple[np.ndarray, int, float | None]:
    """Window numbers of values that follow each other; ``head`` is the first value of window ``number``, None if it was null."""
    out, at, n = np.empty(len(v), np.int64), 0, len(v)
    while at < n:
        step, end = 16, at
        while end < n:
            part = slice(end, min(n, end + step))
            breaks = ~null[part] if head is None else null[part] | (np.abs(v[part] - head) > delta)
            k = int(breaks.argmax())
            if breaks[k]:
                end += k
                break
            end, step = part.stop, step * 4
        out[at:end] = number
        if end < n:
            number, head = number + 1, None if null[end] else float(v[end])
        at = end
    return out, number, head


def _follow(by: list[str], control: str, delta: float):
    """Numbers windows of series that come one after the other, sorted; a series may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, head = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_pylist() for c in by]
            c = b.column(control)
            v = pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False)
            null = np.isnan(v) | np.asarray(pc.is_null(c))
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new[1:] |= np.fromiter((x != y for x, y in zip(k[1:], k, strict=False)), bool, b.num_rows - 1)
            parts, heads = [], np.flatnonzero(new).tolist()
            for lo, hi in zip([0, *heads], [*heads, b.num_rows], strict=True):
                key = tuple(k[lo] for k in keys)
                if key != last:
                    last, number, head = key, 0, None if null[lo] else float(v[lo])
                found, number, head = _numbered(v[lo:hi], null[lo:hi], delta, number, head)
                parts.append(found)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts))], [*b.schema.names, "__w"])

    return run


def group_by_variation(df: DataFrame, control: str, delta: float, aggs: list[Column], by: list[str], time: str = "time", ignore_null: bool = True, columns: list[str] | None = None) -> DataFrame:
    """A new window where the control differs from the window's *first* row by more than ``delta``.

    With ``delta`` 0 any change starts a window, for values of any type, and that is a window
    function.  Else sorted series are followed in Arrow batches, a window at a time; a series may
    be longer than a task's memory.  ``columns`` are those that ``aggs`` need besides the control;
    without it all columns go to the Python workers.
    """
    w = Window.partitionBy(*by).orderBy(time)
    rows = df.where(F.col(control).isNotNull()) if ignore_null else df
    if delta == 0:
        change = ~F.col(control).eqNullSafe(F.lag(control).over(w)) & (F.row_number().over(w) > 1)
        rows = rows.withColumn("__n", F.when(change, 1).otherwise(0)).withColumn("__w", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")
        return _finish(rows, by, "__w", aggs, time)

    if columns is not None:
        rows = rows.select(*dict.fromkeys([*by, time, control, *columns]))
    schema = T.StructType([*rows.schema.fields, T.StructField("__w", T.LongType())])
    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return _finish(dealt.sortWithinPartitions(*by, time).mapInArrow(_follow(by, control, delta), schema), by, "__w", aggs, time)
