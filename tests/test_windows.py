"""Ordered operators: interpolation, rolling frames, islands, split."""

import datetime as dt

from pyspark.sql import functions as F

from ventana.operators import windows as W

from conftest import rows


def _seq(spark, values, series=None):
    base = dt.datetime(2024, 1, 1)
    data = [((series,) if series is not None else ()) + (base + dt.timedelta(hours=i), v)
            for i, v in enumerate(values)]
    schema = ("s long, " if series is not None else "") + "ts timestamp_ntz, x double"
    return spark.createDataFrame(data, schema)


def test_interpolation_positional_forward(spark):
    df = _seq(spark, [None, 1.0, None, None, 4.0, None])
    out = [r[0] for r in W.interpolate(df, ts="ts", cols=["x"]).orderBy("ts").select("x").collect()]
    assert out == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_keeps_known_points_per_series(spark):
    a = _seq(spark, [1.0, None, 3.0, None], series=1)
    b = _seq(spark, [None, 10.0, None, 40.0], series=2)
    out = W.interpolate(a.unionByName(b), ts="ts", cols=["x"], series_cols=["s"])
    r = rows(out.orderBy("s", "ts"), "s", "x")
    assert [x for s, x in r if s == 1] == [1.0, 2.0, 3.0, 3.0]
    assert [x for s, x in r if s == 2] == [None, 10.0, 25.0, 40.0]


def test_rolling_frames(spark):
    vals = [float(i) for i in range(1, 11)]
    vals[2] = None
    df = _seq(spark, vals)
    out = (W.add_rolling_mean(df, ts="ts", col="x", out="full", n=7)
           .transform(lambda d: W.add_rolling_mean(d, ts="ts", col="x", out="min1", n=7, min_periods=1))
           .transform(lambda d: W.add_rolling_mean(d, ts="ts", col="x", out="prev6", n=6, shift=1))
           .orderBy("ts"))
    r = rows(out, "full", "min1", "prev6")
    assert [x[0] for x in r] == [None] * 9 + [7.0]
    assert all(x[1] is not None for x in r)
    assert [x[2] for x in r] == [None] * 9 + [6.5]


def test_islands_and_episodes(spark):
    vals = [61.0] * 6 + [50.0] + [70.0] * 5 + [None] + [70.0] * 2 + [50.0]
    df = _seq(spark, vals).withColumnRenamed("x", "european_aqi")
    isl = W.islands(df, ts="ts", col="european_aqi", threshold=60.0)
    assert isl.count() == len(vals) - 1          # the null row is removed
    ep = W.episodes(df, ts="ts", col="european_aqi").orderBy("episode")
    assert [r["duree"] for r in ep.collect()] == [6, 7]


def test_islands_partition_rows(spark):
    vals = [float((i * 37) % 100) for i in range(200)]
    df = _seq(spark, vals).withColumnRenamed("x", "v")
    isl = W.islands(df, ts="ts", col="v", threshold=50.0)
    runs = isl.groupBy("episode").agg(F.countDistinct("bad").alias("k"), F.count("*").alias("n"))
    assert runs.filter("k != 1").count() == 0
    assert runs.agg(F.sum("n")).first()[0] == 200


def test_chrono_split_is_ordered(spark):
    df = _seq(spark, [float(i) for i in range(10)])
    out = W.chrono_split(df, ts="ts").orderBy("ts")
    assert [r["split"] for r in out.collect()] == ["train"] * 8 + ["test"] * 2
    out2 = W.chrono_split(df, ts="ts", test_share=0.3).orderBy("ts")
    assert [r["split"] for r in out2.collect()] == ["train"] * 7 + ["test"] * 3


def test_last_n_and_lags(spark):
    df = _seq(spark, [float(i) for i in range(5)], series=7)
    assert W.last_n(df, ts="ts", n=2, series_cols=["s"]).count() == 2
    lag = W.add_lags(df, ts="ts", lags={"x": [1, 3]}, series_cols=["s"]).orderBy("ts")
    r = rows(lag, "x_lag_1", "x_lag_3")
    assert r[0] == (None, None) and r[4] == (3.0, 1.0)


def test_last_n_keyless_is_top_n(spark):
    df = _seq(spark, [float(i) for i in range(6)])
    out = W.last_n(df, ts="ts", n=2)
    assert sorted(r["x"] for r in out.collect()) == [4.0, 5.0]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
