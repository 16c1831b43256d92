"""FILL: nulls of a result replaced in output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Duration


def _fill_over_blocks(df: DataFrame, columns: list[str], order: list[Column], block: str, limit, time: str) -> DataFrame:
    """Each block is filled by itself; what it ends with goes to the blocks behind it, of which there is a row each."""
    inner = Window.partitionBy(block).orderBy(*order)
    back, whole = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    have = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(time).alias("t"))) for c in columns}
    rows = df.withColumns({f"__{k}": F.last(have[c], ignorenulls=True).over(back) for k, c in enumerate(columns)} | {f"__tail{k}": F.last(have[c], ignorenulls=True).over(whole) for k, c in enumerate(columns)})
    tails = rows.groupBy(block).agg(*[F.any_value(f"__tail{k}").alias(f"__tail{k}") for k in range(len(columns))])
    before = Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(F.col(block).alias("__block"), *[F.last(f"__tail{k}", ignorenulls=True).over(before).alias(f"__carry{k}") for k in range(len(columns))])
    rows = rows.join(carry, F.col(block).eqNullSafe(F.col("__block")), "left")
    out = {}
    for k, c in enumerate(columns):
        last = F.coalesce(f"__{k}", f"__carry{k}")
        value = last["v"] if limit is None else F.when(F.abs(F.col(time) - last["t"]) <= Duration(limit).micros, last["v"])
        out[c] = F.coalesce(F.col(c), value)
    return rows.withColumns(out).select(*df.columns)


def fill_previous(df: DataFrame, columns: list[str], order: list[Column], by: list[str] | None = None, limit=None, time: str = "time", block: str | None = None) -> DataFrame:
    """The last value before, in the order of the output.

    Without ``by`` the state goes on from device to device, as the order has them.  ``block``
    names the column that the order begins with: then devices are filled side by side, and only
    a row for each of them is ordered as a whole.  Without it, all rows pass one task.  With
    ``limit`` only values that are at most so far away in time are carried.
    """
    if block is not None and not by:
        return _fill_over_blocks(df, columns, order, block, limit, time)
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in columns:
        last = F.last(c, ignorenulls=True).over(w)
        if limit is not None:
            since = F.last(F.when(F.col(c).isNotNull(), F.col(time)), ignorenulls=True).over(w)
            last = F.when(F.abs(F.col(time) - since) <= Duration(limit).micros, last)
        out[c] = F.coalesce(F.col(c), last)
    return df.withColumns(out)


def fill_until_last(df: DataFrame, columns: list[str], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The last value before, but nothing behind the last value of all."""
    base = Window.partitionBy(*(by or [])).orderBy(*order)
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.when(F.first(c, ignorenulls=True).over(ahead).isNotNull(), F.last(c, ignorenulls=True).over(back)) for c in columns})


def fill_linear(df: DataFrame, columns: list[str], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The mean of the values before and after, whatever the times; integers divide as integers."""
    base = Window.partitionBy(*(by or [])).orderBy(*order)
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    kinds = dict(df.dtypes)
    out = {}
    for c in columns:
        total = F.last(c, ignorenulls=True).over(back) + F.first(c, ignorenulls=True).over(ahead)
        # integers divide towards zero
        half = F.when(total < 0, F.ceil(total / 2)).otherwise(F.floor(total / 2)).cast(kinds[c]) if kinds[c] in ("int", "bigint") else total / 2
        out[c] = F.coalesce(F.col(c), half)
    return df.withColumns(out)


def fill_constant(df: DataFrame, columns: list[str], value) -> DataFrame:
    """A constant where it can be cast to the column's type."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).try_cast(kinds[c])) for c in columns})


def fill(df: DataFrame, method: str, columns: list[str], order: list[Column], limit=None, value=None, by: list[str] | None = None) -> DataFrame:
    if limit is not None and method != "previous":
        raise ValueError("a threshold goes with previous only")
    if method == "previous":
        return fill_previous(df, columns, order, by, limit)
    if method == "previousuntillast":
        return fill_until_last(df, columns, order, by)
    if method == "linear":
        return fill_linear(df, columns, order, by)
    if method == "constant":
        return fill_constant(df, columns, value)
    raise ValueError(f"no such fill: {method}")
