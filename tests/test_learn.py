"""Features leak rule, back-test = naive loop, retrain rule, isolation forest."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ventana.operators import features as FT
from ventana.operators import iforest
from ventana.operators import learn as L


COLS = ["pm2_5", "carbon_monoxide"]


def _daily(spark, n, seed=1):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(hours=h), 20 + 10 * math.sin(h / 30) + rnd.random(),
             1 + rnd.random()) for h in range(0, 24 * n, 3)]
    return spark.createDataFrame(data, "date timestamp_ntz, pm2_5 double, carbon_monoxide double")


def test_same_day_target_is_leak(spark):
    f = FT.features_daily(_daily(spark, 20), value_cols=COLS)
    bad = f.filter(F.abs(F.col("pm25_diff") - (F.col("pm2_5") - F.col("pm25_lag_1"))) > 1e-9)
    assert f.count() > 0 and bad.count() == 0


def _days(spark, values, co=None):
    """A daily table from 2024-01-01 on."""
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i), v, 1.0 if co is None else co[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, pm2_5 double, carbon_monoxide double")


def test_backtest_pairs_by_hand(spark):
    """The last seven days are targets, each with the day before as input: of 10 days with values
    10..19 these are days 8-10 only, as a target needs seven days before it."""
    rows = L.backtest_rows(_days(spark, [10.0 + i for i in range(10)]), value_cols=COLS)
    assert sorted((r["pm2_5"], r["actual"]) for r in rows.collect()) == [(16.0, 17.0), (17.0, 18.0), (18.0, 19.0)]
    long = L.backtest_rows(_days(spark, [float(i) for i in range(20)]), value_cols=COLS)
    assert sorted(r["actual"] for r in long.collect()) == [13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0]


def test_backtest_skips_incomplete_inputs_and_short_series(spark):
    values = [float(i * i) for i in range(12)]
    co = [1.0] * 12
    co[8] = None                      # day 9 misses CO; days 10-12 miss one of its three lags
    rows = L.backtest_rows(_days(spark, values, co), value_cols=COLS).collect()
    assert sorted((r["pm2_5"], r["actual"]) for r in rows) == [(36.0, 49.0), (49.0, 64.0)]
    assert L.backtest_rows(_days(spark, values[:7]), value_cols=COLS).count() == 0
    flagged = L.backtest_rows(_days(spark, values, co), value_cols=COLS, flag="used")
    assert flagged.count() == 12 and flagged.filter("used").count() == 2


def test_backtest_metrics_by_hand(spark):
    m = L.backtest_metrics(L.backtest_rows(_days(spark, [10.0 + i for i in range(8)] + [21.0, 18.0]), value_cols=COLS)).first()
    # targets 17 (from 16), 21 (from 17), 18 (from 21): errors 1, 4, -3
    assert m["n_samples"] == 3 and math.isclose(m["mae"], 8 / 3) and math.isclose(m["rmse"], math.sqrt(26 / 3))


def test_retrain_rule(spark):
    cases = [(1, 5.1, 2.0, 0.0), (2, 5.0, 2.0, 0.0), (3, 7.0, 6.0, 0.0), (4, 1.0, 2.0, 0.2)]
    out = {}
    for k, mae, base, share in cases:
        m = spark.createDataFrame([(k, mae)], "k long, mae double")
        s = spark.createDataFrame([(k, share)], "k long, pm25_null_share double")
        r = L.retrain_decision(m, s, series_cols=["k"], baseline={"mae_pm25": base}).first()
        out[k] = (r["needs_retraining"], len(r["reasons"]))
    assert out == {1: (True, 1), 2: (False, 0), 3: (False, 0), 4: (False, 1)}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    r = L.regression_metrics(df, label="y", prediction="p").first()
    assert math.isclose(r["mae"], 1 / 3) and math.isclose(r["mse"], 1 / 6)
    assert math.isclose(r["r2"], 1 - 0.5 / 2.0)


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(0, 1, size=(1000, 4))
    far = rng.normal(12, 0.5, size=(10, 4))
    pdf = pd.DataFrame(np.vstack([normal, far]), columns=["a", "b", "c", "d"])
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    out = iforest.anomalies(df, ["a", "b", "c", "d"], ["id"])
    share = out.agg(F.avg("anomaly")).first()[0]
    assert 0.045 <= share <= 0.055
    assert out.filter("id >= 1000 AND anomaly = 1").count() == 10


def test_isolation_forest_null_rows_get_zero(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"])
    pdf.loc[5, "a"] = None
    pdf["id"] = np.arange(len(pdf))
    out = iforest.anomalies(spark.createDataFrame(pdf), ["a", "b"], ["id"], n_trees=20)
    r = out.filter("id = 5").first()
    assert r["anomaly"] == 0 and r["anomaly_score"] is None


def test_pca_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 1))
    pdf = pd.DataFrame(np.hstack([x, 2 * x + rng.normal(0, 0.01, (500, 1)), rng.normal(size=(500, 1))]),
                       columns=["a", "b", "c"])
    comps, proj = L.pca(spark.createDataFrame(pdf), ["a", "b", "c"], k=2)
    c = comps.filter("component = 1").collect()
    assert c[0]["variance_ratio"] > 0.6 and all(r["cumulative_ratio"] <= 1.0 + 1e-9 for r in c)
    assert proj.count() == 500


def test_pca_raw_variance_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 0.2]])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    comps, _ = L.pca(spark.createDataFrame(pdf), ["a", "b", "c"], k=3)
    got = sorted({r["component"]: r["variance"] for r in comps.collect()}.items())
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    ev = sorted(np.linalg.eigvalsh(np.cov(z, rowvar=False)), reverse=True)
    assert all(math.isclose(v, e, rel_tol=1e-6) for (_, v), e in zip(got, ev))


def test_forest_path_lengths_equal_per_row_walk(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=["a", "b", "c"])
    pdf["id"] = np.arange(len(pdf))
    model = iforest.fit(spark.createDataFrame(pdf), ["a", "b", "c"], ["id"], n_trees=10)
    x = rng.normal(size=(50, 3)) * 3
    fast = model.path_lengths(x)
    for r in range(len(x)):
        total = 0.0
        for feat, thr, left, right, size in model.trees:
            node, depth = 0, 0
            while feat[node] >= 0:
                node = left[node] if x[r, feat[node]] < thr[node] else right[node]
                depth += 1
            total += depth + iforest.c_factor([size[node]])[0]
        assert math.isclose(fast[r], total / len(model.trees), rel_tol=1e-12)
    assert model.psi == 256 and len(model.trees) == 10
    assert all(int(t[4][0]) == 256 for t in model.trees)       # each tree grew on 256 rows
    small = iforest.fit(spark.createDataFrame(pdf.head(100)), ["a", "b", "c"], ["id"], n_trees=3)
    assert small.psi == 100 and all(int(t[4][0]) == 100 for t in small.trees)


def test_forecast_uses_latest_day_only(spark):
    feats = FT.daily_features(FT.daily_table(_daily(spark, 20), value_cols=COLS), drop_incomplete=False)
    train = feats.dropna()
    model = L.fit_gbt(train, features=["pm2_5", "pm25_lag_1", "pm25_rolling_7d"], label="pm25_diff",
                      maxIter=5)
    out = L.forecast_next(model, feats, features=["pm2_5", "pm25_lag_1", "pm25_rolling_7d"]).collect()
    last_day = feats.agg(F.max("day")).first()[0]
    assert len(out) == 1 and out[0]["date_prevision"] == str(last_day + dt.timedelta(days=1))
    gap = feats.withColumn("pm25_lag_1", F.when(F.col("day") == F.lit(last_day), None)
                           .otherwise(F.col("pm25_lag_1")))
    assert L.forecast_next(model, gap, features=["pm2_5", "pm25_lag_1", "pm25_rolling_7d"]).count() == 0


def test_no_decision_without_baseline(spark):
    m = spark.createDataFrame([(1, 50.0)], "k long, mae double")
    share = spark.createDataFrame([(1, 0.2)], "k long, pm25_null_share double")
    r = L.retrain_decision(m, share, series_cols=["k"], baseline=None).first()
    assert r["needs_retraining"] is False and r["mae_threshold"] is None and len(r["reasons"]) == 1
    r = L.retrain_decision(m, share, series_cols=["k"], baseline={"mae_aqi": 1.0}).first()
    assert r["needs_retraining"] is True and r["mae_threshold"] == 5.0       # a baseline without the key counts as 2.0
    assert r["reasons"][0] == "Dégradation de la performance (MAE: 50.00 > seuil 5.00)"


def test_monitoring_report(spark):
    from ventana.operators import stats as S
    hourly = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), v) for h, v in ((0, 1.0), (1, None), (2, 600.0), (3, 2.0))],
                                   "date timestamp_ntz, pm2_5 double")
    perf = spark.createDataFrame([(6.0, 7.0, 7)], "mae double, rmse double, n_samples long")
    r = L.monitoring_report(S.dq_report(hourly), perf, baseline={"mae_pm25": 2.0}).first()
    assert r.data_quality.total_rows == 4 and r.data_quality.missing_values_pct == {"pm2_5": 0.25}
    assert r.data_quality.last_update == "2024-01-01T03:00:00+00:00" and r.data_quality.pm25_range_violation == 1
    assert r.performance.n_samples == 7 and r.baseline_comparison.mae_pm25 == 2.0 and r.needs_retraining
    assert len(r.reasons) == 2 and r.timestamp.endswith("+00:00")
    none = L.monitoring_report(S.dq_report(hourly), perf.limit(0), baseline=None).first()
    assert none.performance is None and none.baseline_comparison is None and not none.needs_retraining


def test_forest_draws_from_all_rows(spark):
    """Each tree takes its rows independently: many distinct rows are used, few by many trees."""
    n, trees, psi = 20_000, 50, 64
    df = spark.range(n).selectExpr("id", "cast(id as double) as x")
    chosen = df.select("id", F.explode(iforest._trees_of_row(psi * 1.5 / n, trees, 7, [F.col("id")])).alias("t"))
    per_tree = [r["count"] for r in chosen.groupBy("t").count().collect()]
    assert len(per_tree) == trees and abs(sum(per_tree) / trees - psi * 1.5) < 6
    used = chosen.select("id").distinct().count()
    expected = n * (1 - (1 - psi * 1.5 / n) ** trees)
    assert abs(used - expected) < 0.05 * expected
    assert chosen.count() == chosen.distinct().count()
    assert df.select(F.size(iforest._trees_of_row(1.0, 9, 7, [F.col("id")])).alias("k")).filter("k <> 9").count() == 0


def _signal(spark, n=160):
    """Next change is a noisy function of today's value: a model can beat persistence, and more
    and more trees only learn the noise."""
    rnd = random.Random(3)
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), x, 0.5 - x + rnd.gauss(0, 0.1)) for i, x in
            enumerate(rnd.random() for _ in range(n))]
    return spark.createDataFrame(rows, "user_id long, day date, x double, change double")


def test_gbt_beats_persistence_stops_early_and_is_saved(spark):
    import tempfile
    df = _signal(spark).withColumn("split", F.when(F.col("day") < "2024-05-01", "train").otherwise("test"))
    fits = []

    def fit(rows):
        fits.append(1)
        return L.fit_gbt(rows.filter("split = 'train'"), validation=rows.filter("split = 'test'"), features=["x"],
                         label="change", maxIter=40, stepSize=0.5, subsamplingRate=1.0, patience=3)

    folder = tempfile.mkdtemp()
    model = L.saved_fit(df, folder, fit)
    assert 1 <= model.n_trees < 40
    err = L.regression_metrics(L.predict(model, df.filter("split = 'test'")), label="change", prediction="prediction").first()
    naive = df.filter("split = 'test'").agg(F.avg(F.abs("change"))).first()[0]
    assert err["mae"] < 0.75 * naive
    again = L.saved_fit(df, folder, fit)
    assert len(fits) == 1 and again == model
    L.saved_fit(df.withColumn("x", F.col("x") + 1), folder, fit)
    assert len(fits) == 2                       # other rows, another model
    L.saved_fit(df, folder, fit, settings={"maxIter": 41})
    L.saved_fit(df.withColumnRenamed("x", "z").withColumnRenamed("z", "x"), folder, fit)
    assert len(fits) == 3                       # other settings, another model; the same again is found
    imp = L.importances(model, ["x"])
    assert math.isclose(sum(v for _, v in imp), 1.0)
    import pytest
    with pytest.raises(ValueError):
        L.saved_fit(df.limit(0), folder, fit)


def test_gbt_queries_build(spark, monkeypatch):
    """Every registered model query runs, with few rounds."""
    from ventana.functions import values as V
    from ventana.plans.catalog import queries
    from conftest import SF01
    monkeypatch.setitem(V.GBT_DAILY, "maxIter", 3)
    monkeypatch.setitem(V.GBT_HOURLY, "maxIter", 2)
    qs = queries()
    test = qs["gbt_fit_predict"](spark, SF01)
    assert test.filter("prediction is not null").count() == qs["holdout_actuals"](spark, SF01).count() > 0
    two = {r["target"]: r["n"] for r in qs["gbt_two_targets"](spark, SF01).collect()}
    n = qs["two_target_rows"](spark, SF01).filter("split = 'test'").first()["n"]
    assert two == {"target_pm25": n, "target_aqi": n}
    imp = qs["importances"](spark, SF01).collect()
    assert math.isclose(sum(r["importance"] for r in imp), 1.0) and [r["rank"] for r in imp] == list(range(1, len(imp) + 1))
    told = qs["gbt_attributions"](spark, SF01)
    from ventana.plans.q_learn import _DAILY_X
    r = told.first()
    assert math.isclose(r["expected"] + sum(r[f] for f in _DAILY_X), r["prediction"], rel_tol=1e-9, abs_tol=1e-9)
    assert test.first()["n_trees"] == 3 and told.count() == test.count()
    for name in ("forecast_next", "forecast_next_day"):
        assert qs[name](spark, SF01).count() == qs["forecast_inputs"](spark, SF01).count()
    naive = {r["user_id"]: r["n_samples"] for r in qs["backtest_naive"](spark, SF01).collect()}
    assert {r["user_id"]: r["n_samples"] for r in qs["backtest_gbt"](spark, SF01).collect()} == naive


def test_two_targets_without_rows_raises(spark, monkeypatch):
    import pytest
    from ventana.plans import q_learn
    monkeypatch.setattr(q_learn, "station_hourly", lambda s, d: s.createDataFrame(
        [], "date timestamp_ntz, " + ", ".join(f"{c} double" for c in q_learn.POLLUTANTS)))
    with pytest.raises(ValueError):
        q_learn.q_gbt_two_targets(spark, "/nowhere")
