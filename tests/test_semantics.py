"""Small cases with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktide.functions import numeric as N
from sparktide.functions import quality as Q
from sparktide.functions import registry, scalar, series
from sparktide.functions import repair as R
from sparktide.model import Duration, instant, path_regex, to_narrow
from sparktide.operators import aggregates, fill, shape, windows
from sparktide.sources import store
from sparktide.streaming import continuous


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def points(spark, values, step=1, device="d"):
    return spark.createDataFrame([(device, i * step, v) for i, v in enumerate(values)], "device string, time long, v double")


def test_durations_and_instants():
    start = instant("2020-10-31")
    ends = [Duration("1mo").after(start, k) for k in range(5)]
    assert ends == [instant(x) for x in ("2020-10-31", "2020-11-30", "2020-12-31", "2021-01-31", "2021-02-28")]
    assert Duration("1mo1d").months == 1 and Duration("1mo1d").micros == 86_400_000_000
    assert instant("2020/01/02T03:04:05+01:00") == instant("2020-01-02T02:04:05") == instant("2020.01.02 02:04:05")
    with pytest.raises(ValueError):
        Duration("1 fortnight")


def test_left_open_labels(spark):
    df = spark.createDataFrame([("d", 9, 1.0)], "device string, time long, v double")
    got = windows.group_by_time(df, 0, 9, 2, [F.count("v").alias("n")], left_open=True, zero=("n",))
    assert rows(got) == [(2, 0), (4, 0), (6, 0), (8, 0), (9, 1)]


def test_session_keeps_equal_gaps(spark):
    df = spark.createDataFrame([("d", t, 1.0) for t in (0, 50, 100, 151)], "device string, time long, v double")
    got = windows.group_by_session(df, 50, [F.count("v").alias("n")], ["device"])
    assert rows(got) == [("d", 0, 100, 3), ("d", 151, 151, 1)]


def test_variation_compares_with_the_head(spark):
    df = points(spark, [1.0, 2.0, 3.0, 4.0, None, 9.0, 8.0])
    got = windows.group_by_variation(df, "v", 2, [F.count("*").alias("n")], ["device"])
    assert rows(got) == [("d", 0, 2, 3), ("d", 3, 3, 1), ("d", 5, 6, 2)]
    kept = windows.group_by_variation(df, "v", 2, [F.count("*").alias("n")], ["device"], ignore_null=False)
    assert rows(kept) == [("d", 0, 2, 3), ("d", 3, 3, 1), ("d", 4, 4, 1), ("d", 5, 6, 2)]


def test_count_windows_drop_the_tail(spark):
    df = points(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0])
    one = windows.group_by_count(df, F.col("v"), 2, [F.sum("v").alias("s")], ["device"])
    assert rows(one) == [("d", 0, 2, 4.0), ("d", 3, 4, 9.0)]
    all_rows = windows.group_by_count(df, F.col("v"), 2, [F.sum("v").alias("s")], ["device"], ignore_null=False)
    assert rows(all_rows) == [("d", 0, 1, 1.0), ("d", 2, 3, 7.0), ("d", 4, 5, 11.0)]


def test_condition_ignores_null(spark):
    df = points(spark, [1.0, None, 1.0, 0.0, 1.0])
    got = windows.group_by_condition(df, F.col("v") > 0, "keep>=2", [F.count("v").alias("n")], ["device"])
    assert rows(got) == [("d", 0, 2, 2)]
    assert rows(windows.group_by_condition(df, F.col("v") > 0, 2, [F.count("v").alias("n")], ["device"], ignore_null=False)) == []


def test_count_if_and_mode_ties(spark):
    df = points(spark, [0.0, 0.0, None, 0.0, 1.0, 0.0, 0.0])
    assert rows(aggregates.count_if(df, F.col("v") == 0, 3, ["device"])) == [("d", 1)]
    assert rows(aggregates.count_if(df, F.col("v") == 0, "keep<3", ["device"])) == [("d", 1)]
    assert rows(aggregates.count_if(df, F.col("v") == 0, 1, ["device"], ignore_null=False)) == [("d", 3)]
    assert rows(aggregates.mode(points(spark, [2.0, 1.0, 1.0, 2.0]), "v", ["device"])) == [("d", 2.0)]
    with pytest.raises(Exception, match="distinct"):
        aggregates.mode(df, "v", ["device"], limit=1).collect()


def test_fills(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 4.0, 3), (3, None, None), (9, 10.0, -4), (10, None, None)], "time long, v double, i int")
    t = [F.col("time")]
    assert [r.v for r in fill.fill(df, "previous", ["v"], t).orderBy("time").collect()] == [None, 4.0, 4.0, 10.0, 10.0]
    assert [r.v for r in fill.fill(df, "previous", ["v"], [F.col("time").desc()]).orderBy("time").collect()] == [4.0, 4.0, 10.0, 10.0, None]
    got = fill.fill(df, "linear", ["v", "i"], t).orderBy("time").collect()
    assert [r.v for r in got] == [None, 4.0, 7.0, 10.0, None] and [r.i for r in got] == [1, 3, 0, -4, None]
    assert fill.fill(df, "constant", ["v", "i"], t, value="x").where("v is null").count() == 3
    with pytest.raises(ValueError):
        fill.fill(df, "linear", ["v"], t, limit="1s")


def test_paths(spark):
    assert path_regex("root.*.d*") == r"^root\.[^.]+\.d[^.]*$"
    wide = spark.createDataFrame([(1, 1.0, None, None), (2, None, None, 3.0)], "time long, `a.x` double, `a.y` double, `b.x` double")
    got = to_narrow(wide, {"a": {"x": "a.x", "y": "a.y"}, "b": {"x": "b.x"}})
    assert rows(got.select("time", "device", "x")) == [(1, "a", 1.0), (2, "b", 3.0)]
    with pytest.raises(ValueError):
        shape.series_page(wide, ["a.x"], 1, 1)


def test_scalars(spark):
    one = spark.range(1).select(
        scalar.MATH["log"](F.lit(0.0)).alias("a"), scalar.string_matches(F.lit("abc"), "b").alias("b"), scalar.trim(F.lit("\t x \n")).alias("c"), scalar.regex_replace(F.lit("a1b2c3"), "[0-9]", "#", 1, 1).alias("d"),
        scalar.regex_replace(F.lit("a1b2c3"), "[0-9]", "#", 1, 0, True).alias("e"), scalar.regex_split(F.lit("a,b,,"), ",").alias("f"), scalar.regex_split(F.lit("a,b,,"), ",", 1).alias("g"), scalar.arithmetic(F.lit(1), "/", F.lit(0)).alias("h"),
    ).first()
    assert tuple(one) == (float("-inf"), False, "x", "a1b#c3", "a1b2c#", 2, "b", None)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([('{"device":"d","timestamp":5,"measurements":["a","b"],"values":[1,null]}',), ('{"device":"e","timestamps":[1,2],"measurements":["a"],"values":[[3],[4]]}',), ("bad",)], "payload string")
    assert rows(store.parse_messages(df)) == [("d", 5, "a", "1"), ("e", 1, "a", "3"), ("e", 2, "a", "4")]
    p = points(spark, [1.0, 2.0])
    store.select_into(p, str(tmp_path / "t"))
    store.select_into(p, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4 and store.upsert(back, ["device", "time"], "v").count() == 2
    store.export_csv(p, str(tmp_path / "c"), 1)
    assert len(list((tmp_path / "c").glob("*.csv"))) >= 2


def test_numeric_definitions():
    t, v = np.arange(8) * 10, np.array([1.0, 3, 2, 5, 4, 6, 8, 7])
    assert np.allclose(N.lowpass(t, v, 1.0)[1] + 0, N.lowpass(t, v, 1.0)[1])
    for m in N.WAVELETS:
        assert np.allclose(N.idwt(t, N.dwt(t, v, m, layer=2)[1], m, layer=2)[1], v)
    with pytest.raises(ValueError):
        N.dwt(t[:7], v[:7])
    q = N.deconv(t, np.convolve([1.0, 2, 3], [4.0, 5]), np.array([4.0, 5]))[1]
    assert np.allclose(q, [1, 2, 3])
    assert N.dtw(t, v, v)[1] == [0.0] and N.dtw(t[:2], np.array([0.0, 1]), np.array([0.0, 3]))[1] == [2.0]
    assert abs(N._gamma_q(1.0, 2.0) - np.exp(-2)) < 1e-12 and abs(N._gamma_q(2.5, 0.5) - 0.9625657732472964) < 1e-9
    y = N.spline(t, v, 8)[1]
    assert np.allclose(y, v)
    rt, rv = R.timestamp_repair(np.array([0, 101, 199, 400]) * 1000, np.array([0.0, 1, 2, 4]))
    assert rt.tolist() == [0, 101_000, 202_000, 303_000, 404_000] and np.array_equal(rv, [0, 1, 2, np.nan, 4], equal_nan=True)
    assert N.outlier(np.arange(9), np.array([1.0, 1, 1, 9, 1, 1, 1, 1, 1]), k=2, r=1, w=4, s=2)[0].tolist() == [3]
    assert N.down_sample(np.array([0, 3, 5, 9, 12]), np.arange(5.0), 5)[0].tolist() == [0, 5, 12]
    assert R.master_repair(t[:1], np.array([1.0]), np.array([1.0]), master=[(1, 1), (9, 9)], k=1)[1].tolist() == [1.0]
    flat = np.concatenate([np.random.default_rng(0).random(20), np.arange(20.0)])
    assert Q.missing_stretches(np.arange(40), flat)[1][22:].all()
    assert np.allclose(R.fill_ar(np.arange(5), np.array([5.0, 2, np.nan, 4, 1]))[1][[0, 4]], [5, 1])


def test_registry(spark):
    registry.create_function("twice", lambda x: 2 * x)
    assert registry.call("TWICE", 4) == 8 and registry.show_functions()["twice"] == "user"
    with pytest.raises(ValueError):
        registry.create_function("m4", lambda x: x)
    registry.drop_function("twice")
    with pytest.raises(ValueError):
        registry.call("twice", 1)
    assert rows(series.integral(points(spark, [1.0, 3.0], 1_000_000), "v", ["device"])) == [("d", 2.0)]


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = continuous.continuous_query(stream, "ts", "1 day", [F.count("*").alias("n"), F.max("value").alias("high")], ["event_type"])
    continuous.into(q, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = src.groupBy(F.window("ts", "1 day")["start"].alias("time"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("high"))
    late = got.agg(F.max("time")).first()[0]
    assert rows(got) == rows(batch.where(F.col("time") <= F.lit(late))) and got.count() > 100
    seen = []
    continuous.trigger(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(seen) == src.count()


def test_down_sampling_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"device": "root.a.d", "time": t, "value": float(t)}) for t in (0, 3, 5, 9, 12)))
    stream = spark.readStream.schema("device string, time long, value double").json(str(tmp_path / "in"))
    piped = continuous.pipe(stream, "root.a", lambda s: continuous.down_sampling(s, 5))
    continuous.into(piped, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("time")) == [(0,), (5,), (12,)]
