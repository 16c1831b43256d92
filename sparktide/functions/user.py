"""User functions over series: row or window functions (UDTF) and aggregates with a state (UDAF).

A UDTF says how it wants its rows - one by one, or in windows by count, time, session or state -
and puts points into a collector.  Series are grouped, so each runs in one task, many side by
side.  A UDAF's states are built and combined within partitions before anything is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..model import Duration, instant


class Parameters(dict):
    """Attributes of a call, as text or values."""

    def get_or(self, name: str, default, kind=str):
        if name not in self:
            return default
        text = self[name]
        return str(text).lower() == "true" if kind is bool else kind(text)

    def need(self, name: str, kind=str):
        if name not in self:
            raise ValueError(f"attribute {name} is missing")
        return self.get_or(name, None, kind)


class Windows:
    """How a function wants its rows; ``cut`` gives (first, end) places of windows in a sorted series."""

    def cut(self, t: np.ndarray, rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
        raise NotImplementedError


@dataclass
class RowByRow(Windows):
    def cut(self, t, rows):
        return ((k, k + 1) for k in range(len(t)))


@dataclass
class BySize(Windows):
    """``size`` rows every ``step`` rows; the last windows may be shorter."""

    size: int
    step: int | None = None

    def cut(self, t, rows):
        return ((k, min(len(t), k + self.size)) for k in range(0, len(t), self.step or self.size))


@dataclass
class ByTime(Windows):
    """Windows of a length every step of time, from ``begin`` (the first row) to ``end``; empty ones too."""

    interval: str | int
    step: str | int | None = None
    begin: str | int | None = None
    end: str | int | None = None

    def cut(self, t, rows):
        if not len(t):
            return
        length, step = Duration(self.interval).micros, Duration(self.step if self.step is not None else self.interval).micros
        begin, end = int(t[0]) if self.begin is None else instant(self.begin), int(t[-1]) + 1 if self.end is None else instant(self.end)
        for a in range(begin, end, step):
            yield int(np.searchsorted(t, a)), int(np.searchsorted(t, min(a + length, end)))


@dataclass
class BySession(Windows):
    """A new window where the step from the row before is greater than ``gap``."""

    gap: str | int

    def cut(self, t, rows):
        edges = np.flatnonzero(np.diff(t) > Duration(self.gap).micros) + 1
        return zip([0, *edges.tolist()], [*edges.tolist(), len(t)], strict=True) if len(t) else iter(())


@dataclass
class ByState(Windows):
    """A new window where the first column differs from the window's first value by more than ``delta`` (0: at all)."""

    delta: float = 0.0

    def cut(self, t, rows):
        values, first = rows.iloc[:, 0].tolist(), 0
        for k in range(1, len(values) + 1):
            if k == len(values) or (abs(values[k] - values[first]) > self.delta if self.delta else values[k] != values[first]):
                yield first, k
                first = k


class Collector:
    """Takes points; a null value is a point without value."""

    def __init__(self):
        self.times, self.values = [], []

    def put(self, time: int, value) -> None:
        self.times.append(int(time))
        self.values.append(value)


class UDTF:
    """``transform`` sees the rows of a window: an index of times and the input columns."""

    output = "double"

    def validate(self, parameters: Parameters, kinds: list[str]) -> None:
        """Raises ValueError for a call that can't be."""

    def before_start(self, parameters: Parameters) -> Windows:
        return RowByRow()

    def transform(self, rows: pd.DataFrame, collector: Collector) -> None:
        raise NotImplementedError

    def terminate(self, collector: Collector) -> None:
        """Called once behind the last row of a series."""


class UDAF:
    """An aggregate: states are made, fed, combined in any order, and turned into a value."""

    output = "double"

    def validate(self, parameters: Parameters, kinds: list[str]) -> None:
        """Raises ValueError for a call that can't be."""

    def before_start(self, parameters: Parameters) -> None:
        """Reads attributes."""

    def create_state(self):
        raise NotImplementedError

    def add_input(self, state, values: pd.Series):
        """The state with values that aren't null, in no order."""
        raise NotImplementedError

    def combine(self, state, other):
        raise NotImplementedError

    def output_final(self, state):
        raise NotImplementedError


def _checked(df: DataFrame, function: type, columns: list[str], parameters: Parameters) -> None:
    kinds = dict(df.dtypes)
    if unknown := [c for c in columns if c not in kinds]:
        raise ValueError(f"no such series: {', '.join(unknown)}")
    function().validate(parameters, [kinds[c] for c in columns])


def run_udtf(df: DataFrame, function: type[UDTF], columns: list[str], by: list[str], time: str = "time", **attributes) -> DataFrame:
    """(by, time, value) points of ``function`` for each series; rows without any of the columns' values are left out."""
    parameters = Parameters(attributes)
    _checked(df, function, columns, parameters)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "time long", f"value {function.output}"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        f, collector = function(), Collector()
        windows, rows = f.before_start(parameters), pdf.set_index(time)[columns]
        for a, b in windows.cut(pdf[time].to_numpy(np.int64), rows):
            f.transform(rows.iloc[a:b], collector)
        f.terminate(collector)
        out = pd.DataFrame({"time": np.array(collector.times, np.int64), "value": collector.values})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0] if len(pdf) else None)
        return out

    return df.select(*by, time, *columns).dropna("all", subset=columns).groupBy(*by).applyInPandas(run, schema)


def run_udaf(df: DataFrame, function: type[UDAF], column: str, by: list[str], **attributes) -> DataFrame:
    """(by, value) of ``function`` for each group."""
    parameters = Parameters(attributes)
    _checked(df, function, [column], parameters)
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)

    def made() -> UDAF:
        f = function()
        f.before_start(parameters)
        return f

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, states = made(), {}
        for b in batches:
            for key, rows in b.groupby(by, dropna=False, sort=False):
                states[key] = f.add_input(states[key] if key in states else f.create_state(), rows[column])
        out = pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*by, "state"])
        yield out

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        f = made()
        states = [pickle.loads(x) for x in pdf["state"]]
        total = states[0]
        for s in states[1:]:
            total = f.combine(total, s)
        return pdf[by].iloc[:1].assign(value=[f.output_final(total)])

    states = df.select(*by, column).dropna(subset=[column]).mapInPandas(partial, f"{keys}, state binary")
    return states.groupBy(*by).applyInPandas(final, f"{keys}, value {function.output}")
