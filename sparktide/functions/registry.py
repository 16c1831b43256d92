"""Functions by name, and user functions: one call per row, window or group."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import numeric, quality, repair, scalar, series

_USER: dict[str, Callable] = {}
#: Parts of functions, which are none themselves.
HELPERS = {"apply", "bottom_up", "swab", "over_time", "deviation", "time_faults", "usual_step", "usual_gap", "consecutive", "value_runs"}


def builtin() -> dict[str, Callable]:
    found = {k: v for m in (series, numeric, quality, repair) for k, v in vars(m).items() if callable(v) and not k.startswith("_") and k not in HELPERS and getattr(v, "__module__", "") == m.__name__}
    return {**scalar.MATH, **found}


def create_function(name: str, function: Callable) -> None:
    if name.lower() in _USER or name.lower() in builtin():
        raise ValueError(f"{name} is there already")
    _USER[name.lower()] = function


def drop_function(name: str) -> None:
    if _USER.pop(name.lower(), None) is None:
        raise ValueError(f"no such function: {name}")


def show_functions() -> dict[str, str]:
    return {**{k: "built-in" for k in builtin()}, **{k: "user" for k in _USER}}


def call(name: str, *args, **parameters):
    f = _USER.get(name.lower()) or builtin().get(name.lower())
    if f is None:
        raise ValueError(f"no such function: {name}")
    return f(*args, **parameters)


def user_functions() -> dict[str, Callable]:
    return dict(_USER)


def series_functions() -> set[str]:
    """Built-in functions that take a series, or several, and give one."""
    return {k for k in builtin() if k not in scalar.MATH}


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False}.get(text.lower(), text)


def over_series(name: str, df: DataFrame, columns: list[str], by: list[str], attributes: dict[str, str]) -> DataFrame:
    """A built-in series function by name, with attributes as text."""
    f = builtin()[name]
    given = {k: _value(v) for k, v in attributes.items()}
    if unknown := set(given) - set(inspect.signature(f).parameters):
        raise ValueError(f"{name} has no attribute {', '.join(sorted(unknown))}")
    if f.__module__ == series.__name__:
        return f(df, *columns, by=by, **given)
    return numeric.apply(df, f, columns if len(columns) > 1 else columns[0], by, **given)


def register_sql(spark: SparkSession, name: str, function: Callable, kind: str) -> None:
    spark.udf.register(name, function, kind)


def windowed(df: DataFrame, function: Callable, schema: str, by: list[str], number: str) -> DataFrame:
    """A user function over each window of rows: ``number`` says which window a row is in."""
    return df.groupBy(*by, number).applyInPandas(function, schema)
