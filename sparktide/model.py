"""Series as rows: (device, time, measurements).  Time is a long, microseconds since 1970.

The narrow form has one row per device and time; the wide form one row per time and a column
per series; the long form one row per point.  Paths are dot-separated under ``root``.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)
UNITS = {"us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 7 * 86_400_000_000}


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def ts_between(column: str, first: int | None = None, last: int | None = None) -> Column:
    """The same bounds on a timestamp column as on its microseconds, ends included.

    Literals of the column's own type reach the Parquet reader, which skips row groups by them.
    """
    at = lambda us: F.lit(EPOCH + timedelta(microseconds=us)).cast("timestamp_ntz")
    low = F.lit(True) if first is None else F.col(column) >= at(first)
    return low if last is None else low & (F.col(column) <= at(last))


def instant(text: str | int | datetime) -> int:
    """A date literal (ISO, slashes or dots, with or without an offset, or now() plus or less a duration) as microseconds."""
    if isinstance(text, int):
        return text
    if isinstance(text, str) and (m := re.fullmatch(r"now\(\)\s*(?:([+-])\s*(\w+))?", text.strip(), re.I)):
        now = instant(datetime.now(UTC))
        return now if m[1] is None else Duration(m[2]).after(now, 1 if m[1] == "+" else -1)
    if isinstance(text, str):
        text = datetime.fromisoformat(re.sub(r"^(\d+)[/.](\d+)[/.](\d+)", r"\1-\2-\3", text.strip()))
    if text.tzinfo is not None:
        text = text.astimezone(UTC).replace(tzinfo=None)
    d = text - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


class Duration:
    """Calendar months and a fixed number of microseconds, as in ``1y2mo3d4h``."""

    def __init__(self, text: str | int):
        self.months, self.micros = 0, 0
        if isinstance(text, int):
            self.micros = text
            return
        parts = re.findall(r"(\d+)(y|mo|w|d|h|ms|us|ns|m|s)", text.lower())
        if "".join(a + b for a, b in parts) != text.lower() or not parts:
            raise ValueError(f"not a duration: {text}")
        for n, unit in parts:
            if unit == "ns":
                if int(n) % 1000:
                    raise ValueError(f"times are whole microseconds: {text}")
                self.micros += int(n) // 1000
            elif unit in ("y", "mo"):
                self.months += int(n) * (12 if unit == "y" else 1)
            else:
                self.micros += int(n) * UNITS[unit]

    def after(self, start: int, times: int = 1) -> int:
        """``start`` plus this duration ``times`` over; the day is that of ``start`` where the month has it."""
        t = datetime.fromtimestamp(start // 1_000_000, UTC).replace(tzinfo=None)
        month = t.year * 12 + t.month - 1 + self.months * times
        year, month = divmod(month, 12)
        last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
        return instant(t.replace(year=year, month=month + 1, day=min(t.day, last))) + start % 1_000_000 + self.micros * times


def path_regex(pattern: str) -> str:
    """``*`` stands for a part of one level, ``**`` for one level or more."""
    out = [re.escape(p) if "*" not in p else (".+" if p == "**" else "[^.]*".join(map(re.escape, p.split("*"))) if p != "*" else "[^.]+") for p in pattern.split(".")]
    return "^" + r"\.".join(out) + "$"


def match_path(path: Column, pattern: str) -> Column:
    return path.rlike(path_regex(pattern))


def expand(columns: list[str], pattern: str) -> list[str]:
    """Columns (series paths) that a pattern names, in order."""
    r = re.compile(path_regex(pattern))
    return [c for c in columns if r.match(c)]


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A series that doesn't exist reads as null."""
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def level(path: Column, *levels: int) -> Column:
    """The path with ``*`` at all levels but the given ones (``root`` is level 0)."""
    parts = F.split(path, r"\.")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i.isin(0, *levels) | (i == F.size(parts) - 1), p).otherwise(F.lit("*"))), ".")


def to_long(df: DataFrame, measurements: list[str], keys: tuple[str, ...] = ("device", "time")) -> DataFrame:
    """Points that are there: keys, measurement, value."""
    return df.unpivot(list(keys), measurements, "measurement", "value").where("value is not null")


def to_wide(df: DataFrame, series: list[str], key: str = "time", name: str = "series", value: str = "value") -> DataFrame:
    """One column per series, one row per time; the list of series saves a scan."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(name) == s, F.col(value))).alias(s) for s in series])


def to_narrow(df: DataFrame, columns: dict[str, dict[str, str]], key: str = "time") -> DataFrame:
    """Wide to narrow: {device: {measurement: column}}; rows without any value are left out."""
    names = sorted({m for c in columns.values() for m in c})
    cells = [F.struct(F.lit(d).alias("device"), *[(F.col(f"`{c[m]}`") if m in c else F.lit(None)).alias(m) for m in names]) for d, c in columns.items()]
    return df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").dropna("all", subset=names)
