"""Scalar functions; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATH = {name: getattr(F, name) for name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "sqrt", "degrees", "radians", "abs")}
MATH |= {"sign": F.signum, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double")}


def _log(f):
    """Logarithms of 0 and of negative numbers as IEEE has them."""
    return lambda c: F.when(c > 0, f(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


MATH |= {"log": _log(F.log), "log10": _log(F.log10)}


def string_contains(c: Column, s: str) -> Column:
    return c.contains(s)


def string_matches(c: Column, regex: str) -> Column:
    """The whole string must match."""
    return c.rlike(rf"\A(?:{regex})\z")


def trim(c: Column) -> Column:
    """Characters up to U+0020 are cut from both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\A[\x00-\x20]+", ""), r"[\x00-\x20]+\z", "")


def in_range(c: Column, lower: float, upper: float) -> Column:
    if lower > upper:
        raise ValueError("lower must not be above upper")
    return c.between(lower, upper)


def on_off(c: Column, threshold: float) -> Column:
    return c >= threshold


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """+ - * / % over doubles; by zero gives null."""
    x, y = a.cast("double"), b.cast("double")
    return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op]


def like(c: Column, pattern: str) -> Column:
    return c.like(pattern)


def const(value: str, kind: str) -> Column:
    return F.lit(value).cast({"int32": "int", "int64": "bigint", "float": "float", "double": "double", "boolean": "boolean", "text": "string"}[kind.lower()])


E_, PI = F.e, F.pi


def regex_match(c: Column, regex: str, group: int = 0) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(regex), F.regexp_extract(c, regex, group))


def regex_replace(c: Column, regex: str, to: str, limit: int = -1, offset: int = 0, reverse: bool = False) -> Column:
    """Replace matches; at most ``limit`` after the first ``offset``, counted from the end if ``reverse``."""
    if limit == -1 and offset == 0:
        return F.regexp_replace(c, regex, to)
    parts = F.split(c, regex)
    found = F.regexp_extract_all(c, F.lit(regex), F.lit(0))
    n = F.size(found)
    number = (lambda i: n - 1 - i) if reverse else (lambda i: i)
    chosen = F.transform(found, lambda m, i: F.when((number(i) >= offset) & ((number(i) < offset + limit) if limit >= 0 else F.lit(True)), F.lit(to)).otherwise(m))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(chosen, i), F.lit("")))), "")


def str_replace(c: Column, target: str, to: str, limit: int = -1, offset: int = 0, reverse: bool = False) -> Column:
    if limit == -1 and offset == 0:
        return F.replace(c, F.lit(target), F.lit(to))
    return regex_replace(c, "\\Q" + target + "\\E", to, limit, offset, reverse)


def regex_split(c: Column, regex: str, index: int = -1) -> Column:
    """The number of parts (index -1) or one of them; empty parts at the end don't count."""
    parts = F.split(c, regex)
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    used = F.when(last > 0, F.slice(parts, 1, F.greatest(last, F.lit(1)))).otherwise(F.slice(parts, 1, F.when(c == "", 1).otherwise(0)))
    return F.size(used) if index == -1 else F.get(used, F.lit(index))
