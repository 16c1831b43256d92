"""The SQL dialect, user functions and schedules: what they reject, and small results."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparktide.functions import registry, user
from sparktide.model import Duration, instant
from sparktide.sources import store
from sparktide.sql import Database, clauses, split_list, time_bounds
from sparktide.streaming.schedule import ContinuousQuery


# classes of this file go to the workers as they are
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def db(spark):
    rows = [("root.sg.d1", 1, 1, 1.5, "a"), ("root.sg.d1", 2, None, 2.5, "b"), ("root.sg.d1", 4, 3, None, "c"), ("root.sg.d2", 1, 10, None, None), ("root.sg.d2", 3, 20, 4.0, "x")]
    out = Database(spark)
    out.register("root.sg", spark.createDataFrame(rows, "device string, time long, s1 int, s2 double, s3 string"), tags=spark.createDataFrame([("root.sg.d1", {"city": "x"}), ("root.sg.d2", {"city": "x"})], "device string, tags map<string,string>"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clauses():
    c = clauses("SELECT count(a), 'x, FROM y' FROM root.* WHERE a IN (1, 2) GROUP BY ([1, 9), 2ms) FILL(PREVIOUS, 3ms) LIMIT 5")
    assert c == {"SELECT": "count(a), 'x, FROM y'", "FROM": "root.*", "WHERE": "a IN (1, 2)", "GROUP BY": "([1, 9), 2ms)", "FILL": "(PREVIOUS, 3ms)", "LIMIT": "5"}
    assert split_list("f(a, b), [1, 2), 'c,d'") == ["f(a, b)", "[1, 2)", "'c,d'"]
    assert time_bounds("time >= 3 AND time < 9 AND a > 1") == (3, 9) and time_bounds("time > 3 OR a > 1") == (None, None)
    assert time_bounds("time BETWEEN 2024-01-01 AND 2024-01-02") == (instant("2024-01-01"), instant("2024-01-02"))


def test_selects(db):
    assert rows(db.sql("SELECT s1 + 1 AS x FROM root.sg.d1 ALIGN BY DEVICE")) == [(1, "root.sg.d1", 2), (4, "root.sg.d1", 4)]
    wide = db.sql("SELECT s1 FROM root.sg.* WHERE time <= 3")
    assert wide.columns == ["time", "root.sg.d1.s1", "root.sg.d2.s1"] and rows(wide) == [(1, 1, 10), (3, None, 20)]
    assert rows(db.sql("SELECT nothing, s1 FROM root.sg.d2 ALIGN BY DEVICE")) == [(1, "root.sg.d2", None, 10), (3, "root.sg.d2", None, 20)]
    assert rows(db.sql("SELECT sum(s1) AS s FROM root.** GROUP BY TAGS(city) ALIGN BY DEVICE")) == [("x", 34.0)]
    assert rows(db.sql("SELECT count(s1) AS n FROM root.** GROUP BY ((0, 4], 2) FILL(0) ALIGN BY DEVICE")) == [("root.sg.d1", 2, 1), ("root.sg.d1", 4, 1), ("root.sg.d2", 2, 1), ("root.sg.d2", 4, 1)]
    assert rows(db.sql("SELECT s1, s2 FROM root.sg.d1 DISABLE ALIGN")) == [(1, "root.sg.d1.s1", "1"), (1, "root.sg.d1.s2", "1.5"), (2, "root.sg.d1.s2", "2.5"), (4, "root.sg.d1.s1", "3")]
    assert db.sql("SELECT s1, s2, s3 FROM root.sg.d1 SLIMIT 1 SOFFSET 1 ALIGN BY DEVICE").columns == ["time", "device", "s2"]
    assert rows(db.sql("SELECT s3 FROM root.sg.** WHERE s3 LIKE 'a%' OR s3 REGEXP '^x$' ORDER BY TIME DESC LIMIT 1 ALIGN BY DEVICE".replace(" LIMIT 1 ALIGN BY DEVICE", " LIMIT 1"))) == [(3, None, "x")]
    assert rows(db.sql("SELECT LAST s1 FROM root.sg.d1")) == [(4, "root.sg.d1.s1", "3", "int")]
    assert rows(db.sql("COUNT NODES root.** LEVEL = 1")) == [(1,)] and rows(db.sql("SHOW DATABASES")) == [("root.sg",)]


@pytest.mark.parametrize(
    "text",
    ["SELECT s1 FROM root.sg.d1 WHERE s1", "SELECT s1, count(s1) FROM root.sg.d1", "SELECT s1 FROM root.sg.d1 GROUP BY ([0, 9), 3)", "SELECT count(s1) FROM root.sg.d1 HAVING s1 > 1", "SELECT LAST sin(s1) FROM root.sg.d1", "SELECT LAST s1 FROM root.sg.d1 SLIMIT 1",
     "SELECT sum(s1) FROM root.** FILL(LINEAR, 3ms)", "SELECT s1 FROM root.other.d", "SELECT s1 FROM root.sg.d1 SOFFSET 3", "SELECT top_k(s1, 'k'='2'), s1 FROM root.sg.d1", "SELECT top_k(s1, 'size'='2') FROM root.sg.d1", "DELETE FROM root.sg.d1.s1 WHERE s1 > 3", "INSERT INTO root.sg.d1(time, s9) VALUES (1, 2)", "EXPLODE"],
)
def test_rejected(db, text):
    with pytest.raises(ValueError):
        db.sql(text)


def test_insert_and_delete(spark):
    out = Database(spark)
    out.register("root", spark.createDataFrame([("root.d", 1, 1, "a"), ("root.d", 2, 2, "b")], "device string, time long, s1 int, s2 string"))
    out.sql("INSERT INTO root.d(time, s1) VALUES (2, 20), (3, 30)")
    out.sql("INSERT INTO root.e(timestamp, s2) VALUES (2024-01-01, 'it')")
    out.sql("DELETE FROM root.d.s2 WHERE time >= 2")
    assert rows(out.sql("SELECT s1, s2 FROM root.** ALIGN BY DEVICE")) == sorted([(1, "root.d", 1, "a"), (2, "root.d", 20, None), (3, "root.d", 30, None), (instant("2024-01-01"), "root.e", None, "it")], key=str)


class Count(user.UDTF):
    output = "long"

    def __init__(self):
        self.n = 0

    def before_start(self, parameters):
        kind = parameters.need("kind")
        return {"size": user.BySize(2, 1), "time": user.ByTime(3, begin=0, end=9), "session": user.BySession(1), "state": user.ByState(0), "row": user.RowByRow()}[kind]

    def transform(self, part: pd.DataFrame, collector):
        self.n += 1
        collector.put(part.index[0] if len(part) else -1, len(part))

    def terminate(self, collector):
        collector.put(100, self.n)


@pytest.mark.parametrize(("kind", "expected"), [("row", [(0, 1), (1, 1), (2, 1), (7, 1), (100, 4)]), ("size", [(0, 2), (1, 2), (2, 2), (7, 1), (100, 4)]), ("time", [(-1, 0), (0, 3), (7, 1), (100, 3)]), ("session", [(0, 3), (7, 1), (100, 2)]), ("state", [(0, 2), (2, 1), (7, 1), (100, 3)])])
def test_access_strategies(spark, kind, expected):
    df = spark.createDataFrame([("d", 0, 1.0), ("d", 1, 1.0), ("d", 2, 2.0), ("d", 7, 1.0), ("d", 8, None)], "device string, time long, v double")
    got = user.run_udtf(df, Count, ["v"], ["device"], kind=kind)
    assert sorted((r.time, r.value) for r in got.collect()) == expected


class Largest(user.UDAF):
    def create_state(self):
        return None

    def add_input(self, state, values):
        top = float(values.max())
        return top if state is None else max(state, top)

    def combine(self, state, other):
        return max(state, other)

    def output_final(self, state):
        return state


def test_user_functions_in_sql(db):
    registry.create_function("largest", Largest)
    registry.create_function("counter", Count)
    try:
        assert rows(db.sql("SELECT largest(s2) AS m FROM root.** ALIGN BY DEVICE")) == [("root.sg.d1", 2.5), ("root.sg.d2", 4.0)]
        assert rows(db.sql("SELECT counter(s1, 'kind'='row') FROM root.sg.d2 ALIGN BY DEVICE"))[0][:2] == ("root.sg.d2", 1)
        with pytest.raises(ValueError, match="kind is missing"):
            user.Parameters().need("kind")
    finally:
        registry.drop_function("largest")
        registry.drop_function("counter")


def test_schedule(spark):
    cq = ContinuousQuery("10us", [F.count("v").alias("n")], "5us", boundary=3)
    assert cq.due(0, 30) == [3, 13, 23] and cq.due(13, 30) == [23] and cq.due(23, 30) == []
    assert ContinuousQuery("10us", [], policy="DISCARD", boundary=3).due(0, 30) == [23]
    assert ContinuousQuery("1s", [], boundary="2024-01-01").due("2023-12-31T23:59:58", "2024-01-01") == [instant("2024-01-01") - 1_000_000, instant("2024-01-01")]
    df = spark.createDataFrame([(t, 1.0) for t in range(20)], "time long, v double")
    seen = {}
    assert list(cq.run(df, 0, 20, lambda out, at: seen.update({at: rows(out)}))) == [3, 13] and seen[13] == [(3, 5), (8, 5)]
    for bad in ({"every": 0}, {"every": "1s", "start_offset": "1s", "end_offset": "2s"}, {"every": "1s", "policy": "later"}):
        with pytest.raises(ValueError):
            ContinuousQuery(aggs=[], **bad)


def test_durations_and_targets():
    assert Duration("2000ns").micros == 2 and abs(instant("now()") - instant("now() - 1h") - 3_600_000_000) < 5_000_000
    with pytest.raises(ValueError):
        Duration("100ns")
    assert store.target_path("root.a.b.s", "root.copy.${1}.${2}.::") == "root.copy.a.b.s"
