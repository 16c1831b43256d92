"""Last points, roll-ups by path and tags, pages of rows and of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import level, match_path


def last_query(df: DataFrame, device: str, measurements: list[str], time: str = "time") -> DataFrame:
    """The latest point of each series: time, timeseries, value (as text) and type.  Only stored series have one."""
    kinds = dict(df.dtypes)
    if unknown := [m for m in measurements if m not in kinds]:
        raise ValueError(f"LAST takes series only: {', '.join(unknown)}")
    cells = [F.max_by(F.struct(F.col(time).alias("t"), F.col(m).cast("string").alias("v")), F.when(F.col(m).isNotNull(), F.col(time))).alias(m) for m in measurements]
    per = df.groupBy(device).agg(*cells)
    names = [F.struct(F.col(m)["t"].alias("time"), F.concat_ws(".", F.col(device), F.lit(m)).alias("timeseries"), F.col(m)["v"].alias("value"), F.lit(kinds[m]).alias("data_type")) for m in measurements]
    return per.select(F.explode(F.array(*names)).alias("x")).select("x.*").where("time is not null")


def require_boolean(df: DataFrame, condition: Column) -> Column:
    """A condition of WHERE or HAVING, which must be boolean."""
    kind = df.select(condition.alias("c")).schema["c"].dataType.simpleString()
    if kind not in ("boolean", "void"):
        raise ValueError(f"a condition must be boolean, this one is {kind}")
    return condition


def without_null(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """WITHOUT NULL ANY or ALL over the given columns."""
    return df.dropna(how.lower(), subset=columns)


def show_devices(df: DataFrame, device: str = "device", pattern: str = "**") -> DataFrame:
    return df.where(match_path(F.col(device), pattern)).select(device).distinct()


def show_timeseries(df: DataFrame, measurements: list[str], device: str = "device", pattern: str = "**") -> DataFrame:
    """Series that have a point: path and type."""
    kinds = dict(df.dtypes)
    there = df.groupBy(device).agg(*[(F.count(m) > 0).alias(m) for m in measurements])
    rows = [F.when(F.col(m), F.struct(F.concat_ws(".", F.col(device), F.lit(m)).alias("timeseries"), F.lit(kinds[m]).alias("data_type"))) for m in measurements]
    return there.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("x.*").where(match_path(F.col("timeseries"), pattern))


def with_tags(catalog: DataFrame, **tags: str) -> DataFrame:
    """Series whose tags contain the given texts."""
    keep = F.lit(True)
    for k, v in tags.items():
        keep &= F.coalesce(F.try_element_at("tags", F.lit(k)).contains(v), F.lit(False))
    return catalog.where(keep)


def align_by_device(frames: dict[str, DataFrame]) -> DataFrame:
    """One narrow table of per-device tables; a measurement that a device lacks is null."""
    out = None
    for device, df in frames.items():
        one = df.withColumn("device", F.lit(device))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def time_join(*frames: DataFrame, time: str = "time") -> DataFrame:
    """Series aligned on equal times; what is missing is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, time, "full_outer")
    return out


def group_by_level(df: DataFrame, path: str, levels: list[int], aggs: list[Column]) -> DataFrame:
    return df.groupBy(level(F.col(path), *levels).alias("path")).agg(*aggs)


def group_by_tags(df: DataFrame, catalog: DataFrame, device: str, tags: list[str], aggs: list[Column]) -> DataFrame:
    """Series that share tag values together; ``catalog`` has a map of tags for each device."""
    named = catalog.select(device, *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags])
    return df.join(named, device).groupBy(*tags).agg(*aggs)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def series_page(df: DataFrame, series: list[str], slimit: int, soffset: int = 0, keys: tuple[str, ...] = ("time",)) -> DataFrame:
    """SLIMIT and SOFFSET: a page of columns."""
    if soffset >= len(series):
        raise ValueError("SOFFSET is beyond the last series")
    return df.select(*keys, *series[soffset : soffset + slimit])


def count_nodes(catalog: DataFrame, path: str, depth: int) -> DataFrame:
    return catalog.agg(F.count_distinct(F.array_join(F.slice(F.split(path, r"\."), 1, depth + 1), ".")).alias("nodes"))
