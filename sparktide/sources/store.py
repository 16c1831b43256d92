"""Writing and reading points: upserts, deletions, time to live, messages, files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Duration

PAYLOAD = "device string, timestamp bigint, timestamps array<bigint>, measurements array<string>, values string"


def upsert(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of rows that share a key the one written last."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delete_ranges(df: DataFrame, tombstones: list[tuple[str | None, int, int]], device: str = "device", time: str = "time") -> DataFrame:
    """Rows outside all (device or None for all, first, last) ranges, ends included."""
    keep = F.lit(True)
    for d, a, b in tombstones:
        hit = F.col(time).between(a, b)
        keep &= ~(hit if d is None else hit & F.col(device).eqNullSafe(F.lit(d)))
    return df.where(keep)


def within_ttl(df: DataFrame, now: int, ttl, time: str = "time") -> DataFrame:
    return df.where(F.col(time) >= now - Duration(ttl).micros)


def target_path(source: str, template: str) -> str:
    """``${n}`` is level n of the source's path, ``::`` its last one."""
    parts = source.split(".")
    return re.sub(r"\$\{(\d+)\}", lambda m: parts[int(m[1])], template).replace("::", parts[-1])


def into_targets(result: DataFrame, targets: dict[str, str], existing: DataFrame | None = None, time: str = "time") -> DataFrame:
    """Points (device, time, measurement, value) of a wide result under their target paths, written over those there.

    ``targets`` has a path for each column, in which levels of the column's own path may stand.
    """
    paths = {c: target_path(c, t) for c, t in targets.items()}
    if len(set(paths.values())) < len(paths):
        raise ValueError("two columns have the same target")
    cells = [F.struct(F.lit(p.rpartition(".")[0]).alias("device"), F.lit(p.rpartition(".")[2]).alias("measurement"), F.col(f"`{c}`").cast("double").alias("value")) for c, p in paths.items()]
    new = result.select(F.col(time).alias("time"), F.explode(F.array(*cells)).alias("x")).select("x.device", "time", "x.measurement", "x.value").where("value is not null")
    if existing is None:
        return new
    both = existing.select("device", "time", "measurement", "value", F.lit(0).alias("__v")).unionByName(new.withColumn("__v", F.lit(1)))
    return upsert(both, ["device", "time", "measurement"], "__v").drop("__v")


def select_into(df: DataFrame, path: str, device: str = "device", mode: str = "append") -> None:
    """Append a result to its target, partitioned by device so that later reads prune."""
    df.write.mode(mode).partitionBy(device).parquet(path)


def parse_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON messages of one time or several: (device, time, measurement, value as text)."""
    m = F.from_json(payload, PAYLOAD)
    one = df.select(m.alias("m")).where("m.device is not null")
    times = F.coalesce(F.col("m.timestamps"), F.array("m.timestamp"))
    rows = F.when(F.col("m.timestamps").isNotNull(), F.from_json("m.values", "array<array<string>>")).otherwise(F.array(F.from_json("m.values", "array<string>")))
    lines = one.select("m.device", "m.measurements", F.explode(F.arrays_zip(times.alias("time"), rows.alias("row"))).alias("x"))
    points = lines.select("device", F.col("x.time").alias("time"), F.explode(F.arrays_zip(F.col("measurements").alias("measurement"), F.col("x.row").alias("value"))).alias("y"))
    return points.select("device", "time", "y.measurement", "y.value").where("value is not null")


def export_csv(df: DataFrame, path: str, lines: int = 10_000) -> None:
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", lines).csv(path)


def export_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)
