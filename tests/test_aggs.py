"""Resampling, shares, wind rose, box statistics, describe."""

import datetime as dt
import math

from pyspark.sql import functions as F

from ventana.operators import profiles as P
from ventana.operators import resample as R
from ventana.operators import stats as S

from conftest import rows


def _two_weeks_gap(spark):
    base = dt.datetime(2024, 1, 1, 12)
    data = [(base + dt.timedelta(days=d), float(d)) for d in range(14) if d not in (3, 4, 5)]
    return spark.createDataFrame(data, "date timestamp_ntz, v double")


def test_calendar_resample_fills_gaps(spark):
    out = R.daily_resample(_two_weeks_gap(spark), ts="date",
                           aggs=[("v_mean", "mean", "v"), ("v_sum", "sum", "v")]).orderBy("day")
    r = rows(out, "v_mean", "v_sum")
    assert len(r) == 14
    assert r[3] == (None, 0.0) and r[5] == (None, 0.0) and r[6] == (6.0, 6.0)


def test_daily_mean_has_no_calendar(spark):
    assert R.daily_mean(_two_weeks_gap(spark), ts="date", value_cols=["v"]).count() == 11


def test_level_shares_sum_to_100_and_keep_levels(spark):
    df = spark.createDataFrame([("Bon",)] * 3 + [("Mauvais",)], "aqi_level string")
    out = rows(P.level_shares(df).orderBy("level_order"), "aqi_level", "n", "share_pct")
    assert out == [("Bon", 3, 75.0), ("Moyen", 0, 0.0), ("Mauvais", 1, 25.0)]


def test_wind_rose_sectors_and_cut(spark):
    data = [(-10.0, 0.0), (0.0, 5.0), (359.9, 20.0), (360.0, 49.9), (10.0, 50.0)]
    df = spark.createDataFrame(data, "d double, s double")
    out = S.wind_rose(df, "d", "s")
    assert out.count() == 80
    got = {(r["sector"], r["speed_bin"]): r["n"] for r in out.filter("n > 0").collect()}
    assert got == {(15, 0): 1, (0, 1): 1, (15, 4): 1, (0, 4): 1}


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, x double")
    r = S.box_stats(df, "x", ["g"]).first()
    assert r["q1"] == 2.25 and r["q3"] == 4.75 and r["n_outliers"] == 1
    assert r["lower_whisker"] == 1.0 and r["upper_whisker"] == 5.0


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, None, 4.0, 8.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = S.describe(df, ["x"]).first()
    d = pd.Series(vals, dtype=float).describe()
    assert r["count"] == d["count"]
    for k, pk in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")]:
        assert math.isclose(r[k], d[pk])


def test_histogram_clamps_max(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    out = rows(S.histogram(df, "x", bins=5).orderBy("bin"), "bin", "n")
    assert out == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_missing_report_and_dq(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, None), (dt.datetime(2024, 1, 2), -1.0, 2.0)],
                               "date timestamp_ntz, pm2_5 double, f double")
    mr = {r["column"]: r["n_missing"] for r in S.missing_report(df).collect()}
    assert mr == {"date": 0, "pm2_5": 0, "f": 1}
    rep = S.dq_report(df, ts="date").first()
    assert rep["total_rows"] == 2 and rep["pm25_range_violation"] == 1
    assert rep["missing_values_pct"]["f"] == 0.5 and rep["last_update"] == "2024-01-02T00:00:00+00:00"


def test_empty_one_row_all_null_keep_schema(spark):
    schema = "date timestamp_ntz, pm2_5 double, pm10 double"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5.0, 6.0)], schema)
    nulls = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, None)], schema)
    for df in (empty, one, nulls):
        for out in (R.daily_resample(df, ts="date", value_cols=["pm2_5"]),
                    P.hour_profile(df, value_cols=["pm2_5"]),
                    S.corr_matrix(df, ["pm2_5", "pm10"]),
                    S.describe(df, ["pm2_5"]),
                    P.kpi_row(df, mean_cols=["pm2_5"], index_col="pm10")):
            out.collect()
            assert len(out.columns) > 0


def test_approx_quartiles_close_to_exact(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    ex = S.describe(df, ["x"]).first()
    ap = S.describe(df, ["x"], approx=True).first()
    assert abs(ex["p50"] - ap["p50"]) <= 1.0 and abs(ex["p75"] - ap["p75"]) <= 1.0


def test_as_of_cuts_future_hours(spark):
    data = [(dt.datetime(2024, 1, 1, h), float(h)) for h in (10, 16, 23)]
    df = spark.createDataFrame(data, "date timestamp_ntz, v double")
    keep = R.daily_resample(df, ts="date", value_cols=["v"]).first()["v"]
    cut = R.daily_resample(df, ts="date", value_cols=["v"], as_of="2024-01-01 16:10:00").first()["v"]
    assert keep == 49.0 / 3 and cut == 13.0


def test_approx_median_aggregate(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h % 24), float(h)) for h in range(101)],
                               "date timestamp_ntz, v double")
    r = R.daily_resample(df, ts="date", aggs=[("m", "median", "v"), ("a", "approx_median", "v")]).first()
    assert r["m"] == 50.0 and abs(r["a"] - 50.0) <= 1.0


def test_skip_all_null_and_half_up_rounding(spark):
    from ventana.functions.exprs import rounded
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert S.skip_all_null(df, ["a", "b"]) == ["a"]
    r = spark.range(1).select(rounded(F.lit(2.5), 0).alias("x"), rounded(F.lit(0.125), 2).alias("y"),
                              rounded(F.lit(2.5), None).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (3.0, 0.13, 2.5)      # half up (rule D5), None keeps all
    daily = R.daily_mean(_two_weeks_gap(spark).withColumn("v", F.col("v") / 3), ts="date",
                         value_cols=["v"], digits=3).orderBy("date_str").collect()[1]
    assert daily["v"] == 0.333


def test_level_shares_per_series(spark):
    df = spark.createDataFrame([(1, "Bon"), (1, "Bon"), (1, "Mauvais"), (2, "Moyen")],
                               "s long, aqi_level string")
    out = rows(P.level_shares(df, series_cols=["s"]).orderBy("s", "level_order"),
               "s", "aqi_level", "n", "share_pct")
    assert out[:3] == [(1, "Bon", 2, 200.0 / 3), (1, "Moyen", 0, 0.0), (1, "Mauvais", 1, 100.0 / 3)]
    assert out[3:] == [(2, "Bon", 0, 0.0), (2, "Moyen", 1, 100.0), (2, "Mauvais", 0, 0.0)]


def test_labels_after_the_published_rounding(spark):
    """A daily mean of 12.0004 is 12.0 to three digits, so it is 'Bon'; an index mean of 50.004 is
    50.0 to two digits, so it is 'Bon'; a share of 50.004 % is 50.0, which is not above 50."""
    from ventana.functions import values as V
    from ventana.functions.exprs import level3
    from ventana.operators import profiles as P
    from ventana.operators import resample as R
    h = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), 12.0004)], "date timestamp_ntz, pm2_5 double")
    d = R.daily_mean(h, value_cols=["pm2_5"], digits=V.MEAN_DIGITS).withColumn("lab", level3("pm2_5")).first()
    assert (d["pm2_5"], d["lab"]) == (12.0, "Bon")
    k = spark.createDataFrame([(1.0, 2.0, 3.0, 50.004)], "pm2_5 double, pm10 double, ozone double, european_aqi double")
    r = P.kpi_row(k).first()
    assert (r["index_mean"], r["index_label"]) == (50.0, "Bon")
    assert P.kpi_row(k.withColumn("european_aqi", F.lit(50.006))).first()["index_label"] == "Modéré"
    rows_ = spark.range(25_000).selectExpr("if(id < 12501, 99.0, 1.0) as pm2_5")     # 50.004 % bad
    s = P.dominant_level(rows_).first()
    assert (s["bad_pct"], s["dominant"]) == (50.0, "Bon")


def test_exact_quantiles_equal_percentile(spark):
    import random
    from ventana.operators import stats as S
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.5, rnd.random() * 100])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in S.exact_quantiles(df, "x", probs, ["g"]).collect()}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", probs).alias("p")).collect() if r["p"]}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for g in got for a, b in zip(got[g], want[g]))
    whole = S.exact_quantiles(df, "x", probs).first()
    ref = df.agg(F.percentile("x", probs)).first()[0]
    assert all(abs(whole[f"q{i}"] - v) < 1e-9 for i, v in enumerate(ref))
    none = df.filter("x is null")
    assert S.exact_quantiles(none, "x", probs).first() == (None,) * 5
    assert S.exact_quantiles(none, "x", probs, ["g"]).count() == 0


def test_distinct_counts_and_empty_histogram(spark):
    from ventana.operators import stats as S
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (None, "b")], "k long, v string")
    got = {r["column"]: (r["n_distinct"], r["n_rows"]) for r in S.distinct_counts(df, ["k", "v"]).collect()}
    assert got == {"k": (2, 4), "v": (2, 4)}
    assert "Expand" not in S.distinct_counts(df, ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    assert {r["n_rows"] for r in S.distinct_counts(df.limit(0), ["k", "v"]).collect()} == {0}
    num = df.withColumn("x", F.lit(1.5))
    full, empty = S.histogram(num, "x", 4, ["k"]), S.histogram(num.limit(0), "x", 4, ["k"])
    assert [(f.name, f.dataType) for f in full.schema] == [(f.name, f.dataType) for f in empty.schema]
    assert full.unionByName(empty).count() == full.count()


def test_box_stats_over_no_rows(spark):
    from ventana.operators import stats as S
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = S.box_stats(df, "x").first()
    assert r["q1"] is None and r["n"] == 0 and r["n_outliers"] == 0


def test_texts_format_the_value_itself(spark):
    from ventana.operators import joins as J
    r = {x["measure"]: x["value_text"] for x in J.threshold_status(
        spark.createDataFrame([(26.845, 2.005)], "pm2_5 double, pm10 double")).collect()}
    assert r["pm2_5"].startswith(f"{26.845:.2f}") and r["pm10"].startswith(f"{2.005:.2f}")


def test_distributed_quantiles_equal_plain(spark):
    from ventana.operators import profiles as P
    df = spark.range(500).selectExpr("if(id % 7 = 0, null, id % 3) as g", "if(id % 5 = 0, null, cast(id % 41 as double)) as x",
                                     "cast(id as double) as y")
    for g in (["g"], []):
        a = P.quantiles(df, value_cols=["x", "y"], series_cols=g)
        b = P.quantiles(df, value_cols=["x", "y"], series_cols=g, distributed=True)
        assert a.columns == b.columns
        for r, t in zip(sorted(a.collect(), key=str), sorted(b.collect(), key=str)):
            assert all(u == v or abs(u - v) < 1e-9 for u, v in zip(r, t))


def test_nice_bins_by_hand(spark):
    """Widths 1, 2, 5 x 10^k; starts as drawn, worked by hand."""
    def bins(values, most):
        return S.nice_bins(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", most)
    # 0.3 to 9.7 in at most 10 bins: 0.94 a bin, so 1 wide; the first multiple at or above 0.3 is 1, the start one below
    assert bins([0.3, 1.25, 2.6, 3.35, 4.4, 5.6, 6.7, 7.35, 8.6, 9.7], 10) == (0.0, 1.0)
    # whole numbers 1 to 50 in at most 30: 1.63 a bin, so 2 wide; bins stand around whole numbers
    assert bins(range(1, 51), 30) == (-0.5, 2.0)
    # 0.00 to 0.10 by hundredths in at most 50: 0.002 a bin, so 0.005; all values lie on edges, so the start moves half a bin
    start, width = bins([i / 100 for i in range(11)] * 3, 50)
    assert abs(width - 0.005) < 1e-12 and abs(start + 0.0025) < 1e-12
    # pressures 990.5 to 1031.2 in at most 4: 10.2 a bin, so 20 wide
    assert bins([990.5, 1001.2, 1013.7, 1031.2], 4) == (980.0, 20.0)
    assert bins([3.5, 3.5], 10)[1] == 1.0 and S.nice_bins(spark.createDataFrame([], "x double"), "x", 5) is None
    h = {r["lo"]: r["n"] for r in S.nice_histogram(spark.createDataFrame([(float(v),) for v in range(1, 51)], "x double"), "x", 30).collect()}
    assert h[-0.5] == 1 and all(n == 2 for lo, n in h.items() if 1 < lo < 49) and sum(h.values()) == 50
    assert S.nice_histogram(spark.createDataFrame([], "x double"), "x", 5).count() == 0
