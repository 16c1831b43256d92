"""Continuous queries, triggers and pipes on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def continuous_query(stream: DataFrame, time: str, interval: str, aggs: list[Column], by: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates of event-time windows, final once the watermark has passed them."""
    windows = F.window(time, interval, slide) if slide else F.window(time, interval)
    out = stream.withWatermark(time, late).groupBy(windows.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("time"), *by, *[c for c in out.columns if c not in ("w", *by)])


def session_query(stream: DataFrame, time: str, gap: str, aggs: list[Column], by: list[str], late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("time"), *by, *[c for c in out.columns if c not in ("w", *by)])


def into(df: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write results to a folder; without ``every`` what is there now is worked off and the query ends."""
    w = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def trigger(stream: DataFrame, fire: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call ``fire`` with each batch of new points."""
    w = stream.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def pipe(stream: DataFrame, pattern: str | None, process: Callable[[DataFrame], DataFrame], device: str = "device") -> DataFrame:
    """Points of devices whose path begins with ``pattern``, through a processor."""
    return process(stream if pattern is None else stream.where(F.col(device).startswith(pattern)))


def down_sampling(stream: DataFrame, interval: int, device: str = "device", time: str = "time", value: str = "value") -> DataFrame:
    """A point of a device is kept if it is at least ``interval`` after the one kept last."""
    kinds = dict(stream.dtypes)
    schema = f"{device} {kinds[device]}, {time} {kinds[time]}, {value} {kinds[value]}"

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        flags = []
        for t in rows[time].tolist():
            flags.append(last is None or t - last >= interval)
            last = t if flags[-1] else last
        if last is not None:
            state.update((last,))
        yield rows[flags][[device, time, value]]

    return stream.groupBy(device).applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def point_counts(stream: DataFrame, device: str = "device") -> DataFrame:
    return stream.groupBy(device).count()
