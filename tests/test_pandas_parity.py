"""Brute-force parity with pandas defaults (the semantics the operators re-express)."""

import datetime as dt
import math

import numpy as np
import pandas as pd

from ventana.operators import resample as R
from ventana.operators import stats as S
from ventana.operators import windows as W


def _series(seed, n=120, null_share=0.3):
    rng = np.random.default_rng(seed)
    v = rng.normal(50, 20, n).round(2)
    v[rng.random(n) < null_share] = np.nan
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)) for h in np.cumsum(rng.integers(1, 5, n))]
    return ts, v


def _close(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    both_nan = np.isnan(a) & np.isnan(b)
    return bool(np.all(both_nan | np.isclose(a, b, rtol=1e-9, atol=1e-9)))


def _frame(spark, ts, v):
    return spark.createDataFrame([(t, None if np.isnan(x) else float(x)) for t, x in zip(ts, v)],
                                 "ts timestamp_ntz, x double")


def test_interpolate_rolling_shift_match_pandas(spark):
    for seed in range(3):
        ts, v = _series(seed)
        s = pd.Series(v)
        df = _frame(spark, ts, v)
        out = W.interpolate(df, ts="ts", cols=["x"])
        out = W.add_rolling_mean(out, ts="ts", col="x", out="r7", n=7)
        out = W.add_rolling_mean(out, ts="ts", col="x", out="r24", n=24, min_periods=1)
        out = W.add_rolling_mean(out, ts="ts", col="x", out="p6", n=6, shift=1)
        out = W.first_diff(out, ts="ts", col="x", out="d1")
        got = out.orderBy("ts").toPandas()
        filled = s.interpolate()
        assert _close(got["x"], filled)
        assert _close(got["r7"], filled.rolling(7).mean())
        assert _close(got["r24"], filled.rolling(24, min_periods=1).mean())
        assert _close(got["p6"], filled.shift(1).rolling(6).mean())
        assert _close(got["d1"], filled.diff())


def test_autocorr_matches_pandas(spark):
    ts, v = _series(7, n=200, null_share=0.1)
    s = pd.Series(v)
    got = {r["lag"]: r["acf"] for r in
           S.autocorr(_frame(spark, ts, v), ts="ts", value_col="x", max_lag=5).collect()}
    for k in range(1, 6):
        assert math.isclose(got[k], s.autocorr(k), rel_tol=1e-9)


def test_describe_and_corr_match_pandas(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=80).round(3)
    b = (a * 0.5 + rng.normal(size=80)).round(3)
    b[::7] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else float(y)) for x, y in zip(a, b)],
                               "a double, b double")
    d = {r["column"]: r for r in S.describe(df, ["a", "b"]).collect()}
    ref = pdf.describe()
    for c in ("a", "b"):
        for k, pk in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                      ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(d[c][k], ref.loc[pk, c], rel_tol=1e-9)
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in S.corr_matrix(df, ["a", "b"]).collect()}
    assert math.isclose(corr[("a", "b")], pdf.corr().loc["a", "b"], rel_tol=1e-9)


def test_daily_resample_matches_pandas(spark):
    ts, v = _series(11, n=150)
    pdf = pd.DataFrame({"x": v}, index=pd.DatetimeIndex(ts))
    ref = pdf.resample("D").agg(["mean", "sum", "max"])
    got = R.daily_resample(_frame(spark, ts, v), ts="ts",
                           aggs=[("m", "mean", "x"), ("s", "sum", "x"), ("mx", "max", "x")]) \
        .orderBy("day").toPandas()
    assert len(got) == len(ref)
    assert _close(got["m"], ref[("x", "mean")]) and _close(got["s"], ref[("x", "sum")])
    assert _close(got["mx"], ref[("x", "max")])
