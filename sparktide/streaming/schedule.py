"""Continuous queries by schedule: a query over a range of time that runs again and again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..model import Duration, instant
from ..operators.windows import group_by_time


@dataclass
class ContinuousQuery:
    """EVERY, BOUNDARY, RANGE and TIMEOUT POLICY of a scheduled query.

    It is executed at ``boundary`` plus multiples of ``every`` and looks at the time from
    ``start_offset`` to ``end_offset`` before its execution.  If executions were missed, policy
    ``blocked`` makes up for all of them, ``discard`` for the last one only.
    """

    every: str | int
    aggs: list[Column]
    interval: str | int | None = None
    by: tuple[str, ...] = ()
    boundary: str | int = 0
    start_offset: str | int | None = None
    end_offset: str | int = 0
    policy: str = "blocked"

    def __post_init__(self):
        self.period = Duration(self.every).micros
        self.start = self.period if self.start_offset is None else Duration(self.start_offset).micros
        self.end = 0 if self.end_offset == 0 else Duration(self.end_offset).micros
        self.policy = self.policy.lower()
        if self.period <= 0:
            raise ValueError("EVERY must be above 0")
        if self.start <= self.end:
            raise ValueError("the range must begin before it ends")
        if self.policy not in ("blocked", "discard"):
            raise ValueError(f"no such timeout policy: {self.policy}")

    def due(self, since, now) -> list[int]:
        """Execution times after ``since`` up to ``now``."""
        first = instant(self.boundary) + -(-(instant(since) + 1 - instant(self.boundary)) // self.period) * self.period
        times = list(range(first, instant(now) + 1, self.period))
        return times[-1:] if self.policy == "discard" else times

    def at(self, source: DataFrame, execution: int, time: str = "time") -> DataFrame:
        """What the execution at this time gives: the windows of its range."""
        length = self.interval if self.interval is not None else self.period
        return group_by_time(source, execution - self.start, execution - self.end, length, self.aggs, by=list(self.by), time=time)

    def run(self, source: DataFrame, since, now, into: Callable[[DataFrame, int], None], time: str = "time") -> Iterator[int]:
        """Executes what is due, in order, and hands each result to ``into``; gives the times that were executed."""
        for execution in self.due(since, now):
            into(self.at(source, execution, time), execution)
            yield execution
