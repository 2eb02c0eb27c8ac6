"""Property: blocked windows equal the plain per-series windows."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from ventana.operators import blocked as B
from ventana.operators import windows as W


def _frame(spark, seed=3, series=4, n=300):
    rnd = random.Random(seed)
    data = []
    for s in range(series):
        t = dt.datetime(2024, 1, 1)
        for i in range(n + 40 * s):
            t += dt.timedelta(minutes=rnd.choice([7, 30, 60, 180, 600]))
            v = None if rnd.random() < 0.3 else round(rnd.uniform(0, 100), 2)
            w = None if rnd.random() < 0.5 else round(rnd.uniform(0, 10), 2)
            data.append((s, t, v, w))
    return spark.createDataFrame(data, "s long, ts timestamp_ntz, v double, w double")


def _same(a, b, key, cols):
    ra = {tuple(r[k] for k in key): [r[c] for c in cols] for r in a.collect()}
    rb = {tuple(r[k] for k in key): [r[c] for c in cols] for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for x, y in zip(ra[k], rb[k]):
            assert (x is None and y is None) or (x is not None and y is not None and
                                                  math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (k, x, y)


def _build(w):
    return {"l1": F.lag("v", 1).over(w), "l3": F.lag("w", 3).over(w),
            "r4": W.rolling_mean_expr(w, "v", 4, 2), "p6": W.rolling_mean_expr(w, "w", 6, 1, shift=1)}


def test_bounded_equals_plain(spark):
    df = _frame(spark)
    plain = df.withColumns(_build(W.series_window(["s"], "ts")))
    blk = B.bounded(df, ts="ts", build=_build, back=6, series_cols=["s"], block_rows=100)
    _same(plain, blk, ["s", "ts"], ["l1", "l3", "r4", "p6"])


def test_bounded_lead_equals_plain(spark):
    df = _frame(spark, seed=5)
    build = lambda w: {"n1": F.lead("v", 1).over(w), "n2": F.lead("w", 2).over(w),
                       "b1": F.lag("v", 1).over(w)}
    plain = df.withColumns(build(W.series_window(["s"], "ts")))
    blk = B.bounded(df, ts="ts", build=build, back=1, ahead=2, series_cols=["s"],
                    block_rows=60)
    _same(plain, blk, ["s", "ts"], ["n1", "n2", "b1"])


def test_blocked_interpolation_equals_plain(spark):
    df = _frame(spark, seed=7)
    plain = W.interpolate(df, ts="ts", cols=["v", "w"], series_cols=["s"])
    blk = B.interpolate(df, ts="ts", cols=["v", "w"], series_cols=["s"], block_rows=80)
    _same(plain, blk, ["s", "ts"], ["v", "w"])


def test_blocked_islands_equal_plain(spark):
    df = _frame(spark, seed=11)
    plain = W.islands(df, ts="ts", col="v", threshold=50.0, series_cols=["s"])
    blk = B.islands(df, ts="ts", col="v", threshold=50.0, series_cols=["s"], block_rows=120)
    _same(plain, blk, ["s", "ts"], ["bad", "episode"])


def test_blocked_keyless(spark):
    df = _frame(spark, seed=13, series=1).drop("s")
    plain = W.interpolate(df, ts="ts", cols=["v"])
    blk = B.interpolate(df, ts="ts", cols=["v"], block_rows=40)
    _same(plain, blk, ["ts"], ["v"])


def test_blocked_autocorr_and_episodes_equal_plain(spark):
    from ventana.operators import stats as S
    df = _frame(spark, seed=17, series=2)
    a = S.autocorr(df, ts="ts", value_col="v", max_lag=5, series_cols=["s"])
    b = S.autocorr(df, ts="ts", value_col="v", max_lag=5, series_cols=["s"], block_rows=60)
    _same(a, b, ["s", "lag"], ["acf"])
    e1 = W.episodes(df, ts="ts", col="v", threshold=30.0, min_rows=2, series_cols=["s"])
    e2 = W.episodes(df, ts="ts", col="v", threshold=30.0, min_rows=2, series_cols=["s"],
                    block_rows=60)
    _same(e1, e2, ["s", "episode"], ["duree", "aqi_max", "aqi_moy"])


def test_blocked_hourly_features_equal_plain(spark):
    from ventana.operators import features as FT
    base = _frame(spark, seed=19, series=2, n=400)
    df = base.select("s", "ts", F.col("v").alias("pm2_5"), F.col("w").alias("european_aqi"))
    df = df.fillna({"pm2_5": 1.0, "european_aqi": 2.0})
    a = FT.features_hourly(df, ts="ts", series_cols=["s"])
    b = FT.features_hourly(df, ts="ts", series_cols=["s"], block_rows=100)
    assert a.count() > 0
    _same(a, b, ["s", "ts"], ["aqi_lag_24", "pm2_5_lag_12", "rolling_aqi_mean", "target_pm25"])
    c = FT.features_reduced(df, ts="ts", series_cols=["s"])
    d = FT.features_reduced(df, ts="ts", series_cols=["s"], block_rows=100)
    _same(c, d, ["s", "ts"], ["aqi_lag_24", "pm2_5_lag_3", "target_aqi"])


def test_blocked_row_index_and_split_equal_plain(spark):
    df = _frame(spark, seed=23, series=3)
    for series in (["s"], []):
        src = df if series else df.filter("s = 0").drop("s")
        a = W.chrono_split(src, ts="ts", series_cols=series)
        b = W.chrono_split(src, ts="ts", series_cols=series, block_rows=80)
        key = [*series, "ts"]
        assert sorted(tuple(r) for r in a.select(*key, "split").collect()) == \
            sorted(tuple(r) for r in b.select(*key, "split").collect())
    idx = B.row_index(df, ts="ts", series_cols=["s"], block_rows=80)
    got = {(r["s"], r["ts"]): (r["_idx"], r["_n"]) for r in idx.collect()}
    from pyspark.sql import Window as Win
    ref = df.withColumn("rn", F.row_number().over(Win.partitionBy("s").orderBy("ts"))) \
        .withColumn("n", F.count(F.lit(1)).over(Win.partitionBy("s")))
    assert all(got[(r["s"], r["ts"])] == (r["rn"], r["n"]) for r in ref.collect())


def test_blocked_bounded_random_reach(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    df = _frame(spark, seed=29, series=2, n=150).cache()
    plain_w = W.series_window(["s"], "ts")

    @settings(max_examples=6, deadline=None)
    @given(back=st.integers(0, 5), ahead=st.integers(0, 3), hours=st.sampled_from([1, 2, 7, 30]))
    def check(back, ahead, hours):
        def build(w):
            cols = {"b": F.lag("v", back).over(w) if back else F.col("v"),
                    "a": F.lead("w", ahead).over(w) if ahead else F.col("w")}
            cols["r"] = F.avg("v").over(w.rowsBetween(-back, ahead))
            return cols
        plain = df.withColumns(build(plain_w))
        blk = B.bounded(df, ts="ts", build=build, back=back, ahead=ahead, series_cols=["s"],
                        block_rows=hours * 20)
        _same(plain, blk, ["s", "ts"], ["b", "a", "r"])

    check()


def test_blocks_follow_row_counts(spark):
    """Half of all rows in one hour of one series, a third of them at one instant."""
    t = dt.datetime(2024, 1, 1)
    data = [(1, t + dt.timedelta(seconds=0 if i % 3 == 0 else i % 3600), i, float(i % 97)) for i in range(3000)]
    data += [(s, t + dt.timedelta(hours=i), 10_000 + i, float(i % 13)) for s in (2, 3) for i in range(1500)]
    df = spark.createDataFrame(data, "s long, ts timestamp_ntz, id long, v double")
    largest = B.cut(df, "ts", ["s"], 500, ["id"]).groupBy("s", "_blk").count().agg(F.max("count")).first()[0]
    assert largest <= 500

    def build(w):
        return {"l2": F.lag("v", 2).over(w), "n1": F.lead("v", 1).over(w)}

    plain = df.withColumns(build(W.series_window(["s"], "ts", "id")))
    blk = B.bounded(df, ts="ts", build=build, back=2, ahead=1, series_cols=["s"], block_rows=500, tiebreak=["id"])
    _same(plain, blk, ["s", "id"], ["l2", "n1"])
    a = W.islands(df, ts="ts", col="v", threshold=50.0, series_cols=["s"], tiebreak=["id"])
    b = B.islands(df, ts="ts", col="v", threshold=50.0, series_cols=["s"], block_rows=500, tiebreak=["id"])
    _same(a, b, ["s", "id"], ["bad", "episode"])
