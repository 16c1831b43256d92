"""Time-series SQL over registered tables of series.

A table has a column of device paths, a time and measurements.  Statements are taken apart into
clauses; names of series functions and literals of time are put into Spark's terms, Spark parses
the expressions, and the operators of this package make the plan.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import registry, user
from .model import instant, match_path, ts_between
from .operators import fill, shape, windows

#: Clauses in the order in which they stand.
CLAUSES = ["SELECT", "INTO", "FROM", "WHERE", "GROUP BY", "HAVING", "FILL", "ORDER BY", "LIMIT", "OFFSET", "SLIMIT", "SOFFSET", "WITHOUT NULL", "ALIGN BY DEVICE", "DISABLE ALIGN"]
TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\d{4}[-/.]\d\d?[-/.]\d\d?(?:[T ]\d\d?:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?|now\(\)(?:\s*[+-]\s*\d\w*)?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\w*|\w+|\s+|<=|>=|!=|<>|==|&&|\|\||.", re.S | re.I)
DATE = re.compile(r"\d{4}[-/.]\d\d?[-/.]\d\d?([T ].*)?$|now\(\).*$", re.I | re.S)
DEVICES = 10_000

there = lambda x: f"CASE WHEN {x} IS NOT NULL THEN time END"
AGGREGATES: dict[str, Callable[..., str]] = {
    "count": lambda x: f"count({x})", "sum": lambda x: f"sum(CAST({x} AS DOUBLE))", "avg": lambda x: f"avg(CAST({x} AS DOUBLE))", "min_value": lambda x: f"min({x})", "max_value": lambda x: f"max({x})",
    "min_time": lambda x: f"min({there(x)})", "max_time": lambda x: f"max({there(x)})", "first_value": lambda x: f"min_by({x}, {there(x)})", "last_value": lambda x: f"max_by({x}, {there(x)})",
    "extreme": lambda x: f"max_by({x}, CASE WHEN {x} IS NOT NULL THEN struct(abs({x}), {x}) END)", "time_duration": lambda x: f"(max({there(x)}) - min({there(x)}))", "spread": lambda x: f"(max({x}) - min({x}))",
    "stddev": lambda x: f"stddev_samp({x})", "stddev_samp": lambda x: f"stddev_samp({x})", "stddev_pop": lambda x: f"stddev_pop({x})", "variance": lambda x: f"var_samp({x})", "var_samp": lambda x: f"var_samp({x})", "var_pop": lambda x: f"var_pop({x})",
    "max_by": lambda x, y: f"max_by({x}, CASE WHEN {y} IS NOT NULL THEN struct({y}, -time) END)", "min_by": lambda x, y: f"min_by({x}, CASE WHEN {y} IS NOT NULL THEN struct({y}, time) END)",
}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def split_list(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand outside brackets."""
    parts, depth = [[]], 0
    for t in tokens(text):
        depth += (t in "([") - (t in ")]")
        if t == mark and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for x in parts if (p := "".join(x).strip())]


def clauses(text: str) -> dict[str, str]:
    """The text of each clause, by name."""
    found, depth, name, words = {}, 0, None, tokens(text.strip().rstrip(";"))
    k = 0
    while k < len(words):
        t = words[k]
        depth += (t in "([") - (t in ")]")
        hit = None
        if not depth or (depth == 1 and t in "(["):
            for c in CLAUSES:
                parts = c.split()
                ahead = [w.upper() for w in words[k : k + 2 * len(parts) - 1] if not w.isspace()]
                if ahead == parts and c not in found:
                    hit = c
        if hit:
            name, found[hit] = hit, ""
            k += 2 * len(hit.split()) - 1
            continue
        if name is None and not t.isspace():
            raise ValueError(f"not a statement: {text[:60]}")
        if name is not None:
            found[name] += t
        k += 1
    return {c: t.strip() for c, t in found.items()}


def is_call(text: str) -> re.Match | None:
    """A function call that is the whole text."""
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", text.strip(), re.S)
    depth = 0
    for t in tokens(m[2]) if m else ():
        depth += (t == "(") - (t == ")")
        if depth < 0:
            return None
    return m


class Expression:
    """An expression in Spark's terms; ``aggregate`` if it has an aggregate function."""

    def __init__(self, text: str):
        self.aggregate = False
        self.spark = self._spark(text)

    def _spark(self, text: str) -> str:
        words, out, k = tokens(text), [], 0
        while k < len(words):
            t = words[k]
            low = t.lower()
            if DATE.match(t):
                out.append(f"{instant(t)}L")
            elif t == "==":
                out.append("=")
            elif t in ("&&", "&"):
                out.append(" AND ")
            elif t in ("||", "|"):
                out.append(" OR ")
            elif low == "regexp":
                out.append("RLIKE")
            elif low in ("contains", "contain"):
                out.append("contains")
            elif k + 1 < len(words) and words[k + 1] == "(" and re.fullmatch(r"\w+", t):
                depth, end = 0, k + 1
                while True:
                    depth += (words[end] == "(") - (words[end] == ")")
                    if not depth:
                        break
                    end += 1
                args = split_list("".join(words[k + 2 : end]))
                if low == "count_time":
                    self.aggregate = True
                    out.append("count(DISTINCT time)")
                elif low in AGGREGATES:
                    self.aggregate = True
                    out.append(AGGREGATES[low](*[self._spark(a) for a in args]))
                else:
                    out.append(f"{t}({', '.join(self._spark(a) for a in args)})")
                k = end
            else:
                out.append(t)
            k += 1
        return "".join(out)

    def column(self) -> Column:
        return F.expr(self.spark)


def time_bounds(condition: str) -> tuple[int | None, int | None]:
    """Bounds on time that hold for all rows that satisfy the condition: those that AND joins at its top."""
    low, high, depth = None, None, 0
    words = [w for w in tokens(condition) if not w.isspace()]
    if any(w.upper() in ("OR", "|", "||", "NOT", "!") for w in words):
        return None, None
    for k, w in enumerate(words):
        depth += (w == "(") - (w == ")")
        if w.lower() != "time" or depth or k + 2 >= len(words):
            continue
        op, value = words[k + 1], words[k + 2]
        if op.upper() == "BETWEEN" and k + 4 < len(words):
            first, last = words[k + 2], words[k + 4]
        elif op in (">", ">=", "=", "==", "<", "<="):
            first, last = (value if op in (">", ">=", "=", "==") else None), (value if op in ("<", "<=", "=", "==") else None)
        else:
            continue
        number = lambda x: instant(x) if DATE.match(x) else int(x) if x.isdigit() else None
        a, b = (number(first) if first else None), (number(last) if last else None)
        low = a if low is None else low if a is None else max(low, a)
        high = b if high is None else high if b is None else min(high, b)
    return low, high


class Database:
    """Tables of series, by the path that their devices begin with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, root: str, df: DataFrame, ts: str | None = None, tags: DataFrame | None = None) -> None:
        """``df`` has ``device`` (full paths), ``time`` and measurements; ``ts`` is a timestamp column of the same times, for the reader; ``tags`` has device and a map."""
        self.tables[root] = (df, ts, tags)

    def sql(self, text: str):
        """The result of a query, or None for a statement."""
        head = text.strip().split(None, 1)[0].upper()
        run = {"SELECT": self._select, "INSERT": self._insert, "DELETE": self._delete, "SHOW": self._show, "COUNT": self._count}.get(head)
        if run is None:
            raise ValueError(f"not a statement: {text[:60]}")
        return run(text.strip().rstrip(";"))

    # sources

    def _table(self, pattern: str) -> str:
        for root in sorted(self.tables, key=len, reverse=True):
            if pattern == root or pattern.startswith(root + ".") or root.startswith(pattern.split("*")[0].rstrip(".")):
                return root
        raise ValueError(f"no series under {pattern}")

    def _source(self, patterns: list[str], bounds: tuple[int | None, int | None]) -> tuple[DataFrame, list[str]]:
        root = self._table(patterns[0])
        df, ts, _ = self.tables[root]
        hit = match_path(F.col("device"), patterns[0])
        for p in patterns[1:]:
            if self._table(p) != root:
                raise ValueError("one query reads the series of one table")
            hit |= match_path(F.col("device"), p)
        if ts is not None and bounds != (None, None):
            df = df.where(ts_between(ts, *bounds))
        measurements = [c for c in df.columns if c not in ("device", "time", ts)]
        return df.where(hit), measurements

    # queries

    def _select(self, text: str) -> DataFrame:
        c = clauses(text)
        if "FROM" not in c:
            raise ValueError("FROM is missing")
        items = split_list(c["SELECT"])
        last = items[0].upper().startswith("LAST ")
        if last:
            items[0] = items[0][5:]
        where = c.get("WHERE", "")
        df, measurements = self._source(split_list(c["FROM"]), time_bounds(where))
        if where:
            df = self._filtered(df, where, measurements)
        if last:
            return self._paged(self._last(df, items, measurements, c), c)
        named, calls = self._items(items, measurements)
        missing = [w for e, _ in named for w in re.findall(r"\b[A-Za-z_]\w*\b(?!\s*\()", e.spark) if w not in df.columns and w.lower() in {i.lower() for i in items}]
        df = df.withColumns({w: F.lit(None).cast("double") for w in dict.fromkeys(missing)})
        if calls:
            if len(items) > 1:
                raise ValueError("a series function and other expressions in one SELECT are not supported")
            out = self._call(df, *calls[0])
        elif any(e.aggregate for e, _ in named):
            if not all(e.aggregate for e, _ in named):
                raise ValueError("raw series and aggregates in one SELECT are not supported")
            out = self._aggregated(df, named, c)
        else:
            if "GROUP BY" in c:
                raise ValueError("GROUP BY needs aggregates")
            out = df.select("time", "device", *[e.column().alias(n) for e, n in named])
            out = out.dropna("all", subset=[n for _, n in named])
        return self._finished(out, c)

    def _items(self, items: list[str], measurements: list[str]):
        named, calls = [], []
        for item in items:
            m = re.fullmatch(r"(.*?)\s+AS\s+[`\"]?(\w+)[`\"]?", item, re.S | re.I)
            text, name = (m[1].strip(), m[2]) if m else (item, item.strip("`"))
            call = is_call(text)
            known = call and call[1].lower() not in AGGREGATES and (call[1].lower() in registry.series_functions() or call[1].lower() in registry.user_functions())
            if known:
                calls.append((call[1].lower(), split_list(call[2]), name))
            elif text == "*":
                named += [(Expression(x), x) for x in measurements]
            elif call and call[2].strip() == "*" and call[1].lower() != "count_time":
                named += [(Expression(f"{call[1]}({x})"), f"{call[1]}({x})") for x in measurements]
            else:
                named.append((Expression(text), name))
        return named, calls

    def _filtered(self, df: DataFrame, condition: str, measurements: list[str]) -> DataFrame:
        e = Expression(condition)
        unknown = {w for w in re.findall(r"\b[A-Za-z_]\w*\b(?!\s*\()", re.sub(r"'[^']*'", "", condition)) if w not in df.columns and w.upper() not in {"AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "REGEXP", "BETWEEN", "TRUE", "FALSE", "CONTAINS", "CASE", "WHEN", "THEN", "ELSE", "END", "L"} and not re.fullmatch(r"\d\w*", w)}
        # a series that isn't there is null
        wide = df.withColumns({w: F.lit(None).cast("double") for w in unknown if not DATE.match(w)})
        return wide.where(shape.require_boolean(wide, e.column())).select(*df.columns)

    def _last(self, df: DataFrame, items: list[str], measurements: list[str], c: dict[str, str]) -> DataFrame:
        if any(is_call(i) for i in items):
            raise ValueError("LAST takes series only")
        if "SLIMIT" in c or "SOFFSET" in c:
            raise ValueError("LAST has no pages of series")
        return shape.last_query(df, "device", measurements if items == ["*"] else items)

    def _call(self, df: DataFrame, name: str, args: list[str], alias: str) -> DataFrame:
        columns = [a for a in args if "=" not in a]
        attributes = {k.strip().strip("'\""): v.strip().strip("'\"") for k, v in (a.split("=", 1) for a in args if "=" in a)}
        f = registry.user_functions().get(name)
        if f is not None and inspect.isclass(f) and issubclass(f, user.UDAF):
            return user.run_udaf(df, f, columns[0], ["device"], **attributes).withColumnRenamed("value", alias)
        if f is not None and inspect.isclass(f) and issubclass(f, user.UDTF):
            out = user.run_udtf(df, f, columns, ["device"], **attributes)
        else:
            out = registry.over_series(name, df, columns, ["device"], attributes)
        value = [x for x in out.columns if x not in ("device", "time")]
        return out.withColumnRenamed(value[0], alias) if len(value) == 1 else out

    def _aggregated(self, df: DataFrame, named, c: dict[str, str]) -> DataFrame:
        aggs = [e.column().alias(n) for e, n in named]
        having = Expression(c["HAVING"]) if "HAVING" in c else None
        if having is not None:
            if not having.aggregate:
                raise ValueError("HAVING needs aggregates")
            aggs.append(having.column().alias("__having"))
        out = self._grouped(df, aggs, [n for e, n in named if re.match(r"\s*count", e.spark)], c.get("GROUP BY", ""))
        if having is None:
            return out
        return out.where(shape.require_boolean(out, F.col("__having"))).drop("__having")

    def _grouped(self, df: DataFrame, aggs: list[Column], counts: list[str], group: str) -> DataFrame:
        if not group:
            return df.groupBy("device").agg(*aggs)
        call = re.fullmatch(r"(SESSION|CONDITION|COUNT|VARIATION|TAGS)\s*\((.*)\)", group, re.S | re.I)
        level = re.fullmatch(r"LEVEL\s*=\s*([\d,\s]+)", group, re.I)
        if level:
            # counts and sums of series add up over the points of all of them
            key = shape.level(F.concat(F.col("device"), F.lit(".*")), *[int(x) for x in split_list(level[1])])
            return df.withColumn("device", F.regexp_replace(key, r"\.\*$", "")).groupBy("device").agg(*aggs)
        if call is None:
            bounds, rest = re.fullmatch(r"\(\s*([\[(][^)\]]*(?:\(\)[^)\]]*)?[\])])\s*,(.*)\)", group, re.S).groups()
            start, end = split_list(bounds[1:-1])
            sizes = split_list(rest)
            number = lambda x: int(x) if x.isdigit() else x
            return windows.group_by_time(df, number(start), number(end), number(sizes[0]), aggs, step=number(sizes[1]) if len(sizes) > 1 else None, by=["device"], left_open=bounds[0] == "(", zero=tuple(counts))
        args = split_list(call[2])
        flags = {k.strip().lower(): v.strip().lower() for k, v in (a.split("=", 1) for a in args[1:] if re.match(r"ignorenull\s*=", a.strip(), re.I))}
        keep_null, plain = flags.get("ignorenull") == "false", [a for a in args if not re.match(r"ignorenull\s*=", a.strip(), re.I)]
        kind = call[1].upper()
        if kind == "SESSION":
            return windows.group_by_session(df, plain[0], aggs, ["device"])
        if kind == "CONDITION":
            keep = plain[1].lower().replace(" ", "") if len(plain) > 1 else 1
            return windows.group_by_condition(df, Expression(plain[0]).column(), int(keep) if str(keep).isdigit() else keep, aggs, ["device"], ignore_null=not keep_null)
        if kind == "COUNT":
            return windows.group_by_count(df, Expression(plain[0]).column(), int(plain[1]), aggs, ["device"], ignore_null=not keep_null)
        if kind == "VARIATION":
            return windows.group_by_variation(df, plain[0], float(plain[1]) if len(plain) > 1 else 0, aggs, ["device"], ignore_null=not keep_null)
        catalog = next(t for d, _, t in self.tables.values() if t is not None)
        return shape.group_by_tags(df, catalog, "device", args, aggs)

    def _finished(self, out: DataFrame, c: dict[str, str]) -> DataFrame:
        values = [x for x in out.columns if x not in ("device", "time", "end_time")]
        if "FILL" in c:
            out = self._fill(out, c["FILL"].strip("() "), values, "device" in out.columns)
        if "WITHOUT NULL" in c:
            out = shape.without_null(out, values, c["WITHOUT NULL"])
        if "SLIMIT" in c or "SOFFSET" in c:
            first = int(c.get("SOFFSET", 0))
            if first >= len(values):
                raise ValueError("SOFFSET is beyond the last series")
            values = values[first : first + int(c.get("SLIMIT", len(values)))]
            out = out.select(*[x for x in out.columns if x in ("device", "time", "end_time")], *values)
        if "DISABLE ALIGN" in c:
            cells = [F.struct(F.concat_ws(".", "device", F.lit(v)).alias("timeseries"), F.col(f"`{v}`").cast("string").alias("value")) for v in values]
            out = out.select("time", F.explode(F.array(*cells)).alias("x")).select("time", "x.*").where("value is not null")
        elif "ALIGN BY DEVICE" not in c and "device" in out.columns:
            out = self._wide(out, values)
        return self._paged(out, c)

    def _fill(self, out: DataFrame, text: str, values: list[str], by_device: bool) -> DataFrame:
        parts = split_list(text)
        method, order = parts[0].lower(), [F.col(x) for x in ("device", "time") if x in out.columns]
        if method in ("previous", "linear", "previousuntillast"):
            by = ["device"] if by_device else None
            return fill.fill(out, method, values, order, limit=parts[1] if len(parts) > 1 else None, by=by)
        if len(parts) > 1:
            raise ValueError("a threshold goes with previous only")
        return fill.fill(out, "constant", values, order, value=parts[0].strip("'\""))

    def _wide(self, out: DataFrame, values: list[str]) -> DataFrame:
        """A column for each series; the devices of the result are few, or the query should be aligned by device."""
        devices = sorted(r[0] for r in out.select("device").distinct().limit(DEVICES + 1).collect())
        if len(devices) > DEVICES:
            raise ValueError("too many series for columns; use ALIGN BY DEVICE")

        def name(device: str, value: str) -> str:
            call = is_call(value)
            return f"{call[1]}({device}.{call[2]})" if call and "," not in call[2] else f"{device}.{value}"

        cells = [F.max(F.when(F.col("device") == d, F.col(f"`{v}`"))).alias(name(d, v)) for d in devices for v in values]
        keys = [x for x in ("time", "end_time") if x in out.columns]
        return out.groupBy(*keys).agg(*cells) if cells else out.select(*keys)

    def _paged(self, out: DataFrame, c: dict[str, str]) -> DataFrame:
        order = [k for k in ("time", "device") if k in out.columns]
        if "ORDER BY" in c:
            order = []
            for part in split_list(c["ORDER BY"]):
                m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?", part.strip(), re.S | re.I)
                key = m[1].strip()
                col = F.col(key.lower()) if key.lower() in ("time", "device", "timeseries") else F.col(f"`{key}`") if key in out.columns else Expression(key).column()
                down, first = (m[2] or "").upper() == "DESC", (m[3] or "").upper() == "FIRST"
                order.append((col.desc_nulls_first() if first else col.desc_nulls_last()) if down else (col.asc_nulls_first() if first or not m[3] else col.asc_nulls_last()))
        if "ORDER BY" in c or "LIMIT" in c or "OFFSET" in c:
            out = out.orderBy(*order) if order else out
        if "OFFSET" in c:
            out = out.offset(int(c["OFFSET"]))
        return out.limit(int(c["LIMIT"])) if "LIMIT" in c else out

    # statements

    def _insert(self, text: str) -> None:
        m = re.fullmatch(r"INSERT\s+INTO\s+([\w.`]+)\s*\(([^)]*)\)\s*(?:ALIGNED\s+)?VALUES\s*(.*)", text, re.S | re.I)
        if m is None:
            raise ValueError(f"not an INSERT: {text[:60]}")
        device, names = m[1], [x.strip() for x in m[2].split(",")]
        root = self._table(device)
        df, ts, tags = self.tables[root]
        if names[0].lower() not in ("timestamp", "time") or (unknown := [n for n in names[1:] if n not in df.columns]):
            raise ValueError(f"INSERT takes a timestamp and known series: {names if names[0].lower() not in ('timestamp', 'time') else unknown}")
        rows = []
        for row in split_list(m[3]):
            cells = split_list(row.strip()[1:-1])
            at = instant(cells[0]) if DATE.match(cells[0]) else int(cells[0])
            rows.append((at, *[None if x.lower() == "null" else x.strip("'\"") for x in cells[1:]]))
        new = self.spark.createDataFrame(rows, "time long, " + ", ".join(f"`{n}` string" for n in names[1:]))
        kinds = dict(df.dtypes)
        given = new.select(F.lit(device).alias("device"), "time", *[F.col(n).cast(kinds[n]).alias(n) for n in names[1:]], F.lit(1).alias("__v"))
        base = df.drop(ts) if ts else df
        both = base.withColumn("__v", F.lit(0)).unionByName(given, allowMissingColumns=True)
        # of each series the value written last; a null writes nothing
        values = [x for x in base.columns if x not in ("device", "time")]
        self.tables[root] = (both.groupBy("device", "time").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__v"))).alias(v) for v in values]).select(*base.columns), None, tags)

    def _delete(self, text: str) -> None:
        m = re.fullmatch(r"DELETE\s+FROM\s+([\w.*`]+)(?:\s+WHERE\s+(.*))?", text, re.S | re.I)
        pattern, _, series = m[1].rpartition(".")
        root = self._table(pattern)
        df, ts, tags = self.tables[root]
        hit = match_path(F.col("device"), pattern)
        if m[2]:
            if unknown := [w for w in re.findall(r"[A-Za-z_]\w*", re.sub(DATE.pattern[:-1], "", m[2])) if w.lower() not in ("time", "and", "or", "between", "now", "t", "l")]:
                raise ValueError(f"DELETE takes conditions on time only: {unknown}")
            hit &= Expression(m[2]).column()
        measurements = [x for x in df.columns if x not in ("device", "time", ts)]
        gone = measurements if series in ("*", "**") else [series]
        self.tables[root] = (df.withColumns({g: F.when(~hit, F.col(g)) for g in gone}).dropna("all", subset=measurements), ts, tags)

    def _show(self, text: str) -> DataFrame:
        m = re.fullmatch(r"SHOW\s+(DEVICES|TIMESERIES|DATABASES|FUNCTIONS)(?:\s+([\w.*]+))?(?:\s+LIMIT\s+(\d+))?", text, re.S | re.I)
        if m is None:
            raise ValueError(f"not a SHOW: {text[:60]}")
        kind = m[1].upper()
        if kind == "FUNCTIONS":
            return self.spark.createDataFrame(sorted(registry.show_functions().items()), "name string, type string")
        if kind == "DATABASES":
            return self.spark.createDataFrame([(r,) for r in sorted(self.tables)], "database string")
        df, measurements = self._source([m[2] if m[2] and kind == "DEVICES" else self._table(m[2] or "root") + ".**"], (None, None))
        out = shape.show_devices(df) if kind == "DEVICES" else shape.show_timeseries(df, measurements, pattern=m[2] or "**")
        return out.limit(int(m[3])) if m[3] else out

    def _count(self, text: str) -> DataFrame:
        m = re.fullmatch(r"COUNT\s+(DEVICES|TIMESERIES|NODES)\s+([\w.*]+)(?:\s+LEVEL\s*=\s*(\d+))?", text, re.S | re.I)
        if m is None:
            raise ValueError(f"not a COUNT: {text[:60]}")
        if m[1].upper() == "NODES":
            devices = self._show(f"SHOW DEVICES {m[2]}")
            return shape.count_nodes(devices.withColumnRenamed("device", "path"), "path", int(m[3]))
        return self._show(f"SHOW {m[1]} {m[2]}").agg(F.count("*").alias("count"))

