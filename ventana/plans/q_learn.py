"""Features, split, metrics, back-test, retrain decision, models (phases 5-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import rounded
from ..operators import columns as C
from ..operators import features as FT
from ..operators import iforest
from ..operators import learn as L
from ..operators import resample as R
from ..operators import windows as W
from ..session import checkpoint_dir, kept
from .registry import ORACLES, query
from .sqltext import corr, interp_select, rnd, rolling_mean, ts_txt, win
from .standins import H_SQL, POLLUTANTS, U_SQL, station_hourly, table, users_hourly, with_ctes

US = ["user_id"]
TWO_PI = "6.283185307179586"

# --- SQL pieces: per-series daily calendar, interpolation, features -----------------

_D = ("SELECT user_id, CAST(date AS DATE) AS day, "
      + ", ".join(f"avg({c}) AS {c}" for c in POLLUTANTS) + " FROM U GROUP BY 1, 2")
_UD = """SELECT c.user_id, c.day, d.* EXCLUDE (user_id, day) FROM (
  SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)) c
LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day"""
_I = interp_select(POLLUTANTS, US, "day", "ud", ["user_id", "day"])


def _feat_sql(diff="same_day"):
    w = win(US, "day")
    lags = ", ".join(f"lag(pm2_5, {i}) {w} AS pm25_lag_{i}, lag(carbon_monoxide, {i}) {w} AS co_lag_{i}"
                     for i in range(1, 4))
    d = f"pm2_5 - lag(pm2_5, 1) {w}" if diff == "same_day" else f"lead(pm2_5, 1) {w} - pm2_5"
    return (f"SELECT user_id, day, {', '.join(POLLUTANTS)}, {d} AS pm25_diff, {lags}, "
            f"{rolling_mean('pm2_5', US, 'day', 7)} AS pm25_rolling_7d, "
            f"CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month FROM i")


_FCOLS = [*POLLUTANTS, "pm25_diff", "pm25_lag_1", "co_lag_1", "pm25_lag_2", "co_lag_2", "pm25_lag_3",
          "co_lag_3", "pm25_rolling_7d", "day_of_week", "month"]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _FCOLS)
_CTES = dict(U=U_SQL, d=_D, ud=_UD, i=_I, fx=_feat_sql())


def _daily_filled(spark, sf):
    return FT.daily_table(users_hourly(spark, sf), ts="date", value_cols=POLLUTANTS,
                          series_cols=US)


def _features_daily(spark, sf, target="same_day"):
    return FT.daily_features(_daily_filled(spark, sf), series_cols=US, target=target)


@query("features_daily", with_ctes(
    f"SELECT user_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(_FCOLS)} FROM fx WHERE {_COMPLETE}",
    **_CTES))
def q_features_daily(spark, sf):
    """M1: daily calendar -> interpolation -> diff, lags, 7-day mean, calendar -> complete rows."""
    return _features_daily(spark, sf)


_HLAGS = (1, 3, 6, 12, 24)


def _hourly_feat_sql(series):
    w = win(series, "date")
    keys = [*series]
    cols = [*keys, "date", *POLLUTANTS, "hour", "dayofweek", "hour_sin", "hour_cos",
            *[f"aqi_lag_{k}" for k in _HLAGS], *[f"pm2_5_lag_{k}" for k in _HLAGS],
            "rolling_aqi_mean", "target_pm25", "target_aqi"]
    inner = (f"SELECT {', '.join(keys + ['date'] + POLLUTANTS)}, CAST(hour(date) AS INTEGER) AS hour, "
             f"CAST(isodow(date) - 1 AS INTEGER) AS dayofweek, "
             f"sin({TWO_PI} * hour(date) / 24.0) AS hour_sin, cos({TWO_PI} * hour(date) / 24.0) AS hour_cos, "
             + ", ".join(f"lag(european_aqi, {k}) {w} AS aqi_lag_{k}" for k in _HLAGS) + ", "
             + ", ".join(f"lag(pm2_5, {k}) {w} AS pm2_5_lag_{k}" for k in _HLAGS) + ", "
             f"{rolling_mean('european_aqi', series, 'date', 6, None, 1)} AS rolling_aqi_mean, "
             f"lead(pm2_5, 1) {w} AS target_pm25, lead(european_aqi, 1) {w} AS target_aqi FROM U")
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    out = ", ".join(ts_txt("date") + " AS date" if c == "date" else c for c in cols)
    return f"SELECT {out} FROM ({inner}) WHERE {complete}"


@query("features_hourly", with_ctes(_hourly_feat_sql([]).replace("FROM U", "FROM H"), H=H_SQL))
def q_features_hourly(spark, sf):
    """M2: hourly features of the station: calendar, cyclic hour, lags,
    previous-6 mean, t+1 targets, complete rows only."""
    return FT.features_hourly(station_hourly(spark, sf))


def _reduced_sql():
    w = win([], "date")
    keep = ["pm2_5", "pm10", "ozone", "european_aqi"]
    cols = ["date", *keep, "hour_sin", "hour_cos", *[f"aqi_lag_{k}" for k in (1, 3, 6, 24)],
            *[f"pm2_5_lag_{k}" for k in (1, 3, 24)], "target_pm25", "target_aqi"]
    inner = (f"SELECT date, {', '.join(keep)}, sin({TWO_PI} * hour(date) / 24.0) AS hour_sin, "
             f"cos({TWO_PI} * hour(date) / 24.0) AS hour_cos, "
             + ", ".join(f"lag(european_aqi, {k}) {w} AS aqi_lag_{k}" for k in (1, 3, 6, 24)) + ", "
             + ", ".join(f"lag(pm2_5, {k}) {w} AS pm2_5_lag_{k}" for k in (1, 3, 24)) + ", "
             f"lead(pm2_5, 1) {w} AS target_pm25, lead(european_aqi, 1) {w} AS target_aqi FROM H")
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    out = ", ".join(ts_txt("date") + " AS date" if c == "date" else c for c in cols)
    return with_ctes(f"SELECT {out} FROM ({inner}) WHERE {complete}", H=H_SQL)


@query("features_reduced", _reduced_sql())
def q_features_reduced(spark, sf):
    """M3: reduced hourly features of the station (listed columns dropped)."""
    return FT.features_reduced(station_hourly(spark, sf))


_TWO_TARGET_ROWS = with_ctes(f"""
SELECT split, count(*) AS n, avg(target_pm25) AS pm25_mean, avg(target_aqi) AS aqi_mean FROM (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY date) <= count(*) OVER () - ceil(count(*) OVER () * 0.3)
            THEN 'train' ELSE 'test' END AS split FROM fh) GROUP BY 1""",
    H=H_SQL, fh=_hourly_feat_sql([]).replace("FROM U", "FROM H"))

#: Rows a block of the blocked twins holds: far below the series' length, so that edges matter.
_BLOCK = 200


@query("features_hourly_blocked", ORACLES["features_hourly"])
def q_features_hourly_blocked(spark, sf):
    """M2 without a series: one window over all rows, cut into blocks."""
    return FT.features_hourly(station_hourly(spark, sf), block_rows=_BLOCK)


@query("features_reduced_blocked", ORACLES["features_reduced"])
def q_features_reduced_blocked(spark, sf):
    """M3 without a series, in blocks."""
    return FT.features_reduced(station_hourly(spark, sf), block_rows=_BLOCK)


@query("two_target_rows_blocked", _TWO_TARGET_ROWS)
def q_two_target_rows_blocked(spark, sf):
    """The rows of the 70/30 split of all hourly features, numbered in blocks."""
    f = W.chrono_split(FT.features_hourly(station_hourly(spark, sf), block_rows=_BLOCK), ts="date", test_share=0.3,
                       block_rows=_BLOCK)
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("target_pm25").alias("pm25_mean"),
                                  F.avg("target_aqi").alias("aqi_mean"))


@query("chrono_split", with_ctes(f"""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, pm2_5,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY day)
                 <= floor(count(*) OVER (PARTITION BY user_id) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM fx WHERE {_COMPLETE}""", **_CTES))
def q_chrono_split(spark, sf):
    """First floor(0.8 n) feature rows of each series train, the rest test."""
    f = _features_daily(spark, sf)
    return W.chrono_split(f, ts="day", series_cols=US).select("user_id", "day", "pm2_5", "split")


@query("metrics_naive", with_ctes(f"""
SELECT user_id, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
       1.0 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2, count(*) AS n
FROM (SELECT user_id, lead(pm2_5, 1) {win(US, 'day')} AS y, pm2_5 AS p FROM i)
WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1""", U=U_SQL, d=_D, ud=_UD, i=_I))
def q_metrics_naive(spark, sf):
    """M6 on the persistence forecast (tomorrow = today) of every series."""
    filled = _daily_filled(spark, sf)
    pairs = W.add_lead(filled, ts="day", col="pm2_5", out="actual", series_cols=US)
    return L.regression_metrics(pairs, label="actual", prediction="pm2_5", series_cols=US)


_BT_INPUTS = [*POLLUTANTS, "pm25_lag_1", "co_lag_1", "pm25_lag_2", "co_lag_2", "pm25_lag_3",
              "co_lag_3", "pm25_rolling_7d", "day_of_week", "month"]
_BT = f"""SELECT user_id, pm2_5, actual FROM (
  SELECT *, row_number() {win(US, 'day')} AS idx, count(*) OVER (PARTITION BY user_id) AS n,
         lead(pm2_5, 1) {win(US, 'day')} AS actual FROM fx)
WHERE idx <= n - 1 AND idx >= 7 AND idx >= n - 7 AND {' AND '.join(f'{c} IS NOT NULL' for c in _BT_INPUTS)}"""


@query("backtest_naive", with_ctes("""
SELECT user_id, avg(abs(actual - pm2_5)) AS mae, sqrt(avg((actual - pm2_5) * (actual - pm2_5))) AS rmse,
       count(*) AS n_samples FROM bt GROUP BY 1""", **_CTES, bt=_BT))
def q_backtest_naive(spark, sf):
    """M11 with the persistence forecast: last 7 days of every series."""
    rows = L.backtest_rows(_daily_filled(spark, sf), series_cols=US, value_cols=POLLUTANTS)
    return L.backtest_metrics(rows, series_cols=US)


_THR = max(V.BASELINE_METRICS["mae_pm25"] * V.RETRAIN_FACTOR, V.RETRAIN_FLOOR)


@query("retrain_decision", with_ctes(f"""
SELECT s.user_id, m.mae, CAST({_THR} AS DOUBLE) AS mae_threshold, coalesce(m.mae > {_THR}, false) AS needs_retraining,
       concat_ws(' | ',
         CASE WHEN coalesce(m.mae > {_THR}, false)
              THEN 'Dégradation de la performance (MAE: ' || printf('%.2f', m.mae) || ' > seuil {_THR:.2f})' END,
         CASE WHEN s.pm25_null_share > 0.1 THEN '{V.REASON_NULLS}' END) AS reasons
FROM (SELECT user_id, count_if(pm2_5 IS NULL) / count(*) AS pm25_null_share FROM U GROUP BY 1) s
LEFT JOIN (SELECT user_id, avg(abs(actual - pm2_5)) AS mae FROM bt GROUP BY 1) m ON s.user_id = m.user_id""",
    **_CTES, bt=_BT))
def q_retrain_decision(spark, sf):
    """Per series, back-test MAE against the threshold, plus the null-share reason; the nulls
    are counted in the daily aggregation and carried along, so the readings are scanned once."""
    u = users_hourly(spark, sf).withColumns({"_null": F.col("pm2_5").isNull().cast("int"), "_one": F.lit(1)})
    daily = R.daily_resample(u, ts="date", series_cols=US, aggs=[
        *[(c, "mean", c) for c in POLLUTANTS], ("_nulls", "sum", "_null"), ("_rows", "sum", "_one")])
    filled = W.interpolate(daily, ts="day", cols=POLLUTANTS, series_cols=US)
    rows = L.backtest_rows(filled, series_cols=US, value_cols=POLLUTANTS, flag="_used")
    err = F.when(F.col("_used"), F.abs(F.col("actual") - F.col("pm2_5")))
    per_series = rows.groupBy("user_id").agg(F.avg(err).alias("mae"),
                                             (F.sum("_nulls") / F.sum("_rows")).alias("pm25_null_share"))
    return L.decide(per_series).select("user_id", "mae", "mae_threshold", "needs_retraining",
                                       F.array_join("reasons", " | ").alias("reasons"))


# --- models (rows-only checks) ---------------------------------------------------

_DAILY_X = [*POLLUTANTS, "pm25_lag_1", "co_lag_1", "pm25_lag_2", "co_lag_2", "pm25_lag_3", "co_lag_3",
            "pm25_rolling_7d", "day_of_week", "month"]


def _daily_split(spark, sf, target="same_day"):
    """(split feature rows, feature rows of all days): each written once, as a fit and what follows it read them many times."""
    every = kept(FT.daily_features(_daily_filled(spark, sf), series_cols=US, target=target, drop_incomplete=False), "daily")
    return kept(W.chrono_split(every.dropna(), ts="day", series_cols=US), "daily-split"), every


def _daily_model(spark, sf, target, **params):
    """(model, split feature rows, feature rows of all days): fitted on the earlier rows of every series with the published
    rounds and never on the later ones; saved in the shared folder under a digest of its training rows and settings."""
    f, every = _daily_split(spark, sf, target)
    used = f.filter("split = 'train'").select(*_DAILY_X, "pm25_diff")
    folder = f"{checkpoint_dir(spark)}/models/daily"
    model = L.saved_fit(used, folder, lambda rows: L.fit_gbt(rows, features=_DAILY_X, label="pm25_diff", **params),
                        settings={"features": _DAILY_X, "label": "pm25_diff", **V.GBT_DAILY, **params})
    return model, f, every


@query("gbt_fit_predict")
def q_gbt_fit_predict(spark, sf):
    """M4 + M13 + M6: boosted trees on the daily features (reference target),
    chronological 80/20 split per series; hold-out rows with predictions and the number of trees."""
    model, f, _ = _daily_model(spark, sf, "same_day")
    test = L.predict(model, f.filter("split = 'test'"))
    return test.select("user_id", "day", F.col("pm25_diff").alias("actual"), "prediction",
                       F.lit(model.n_trees).alias("n_trees"))


@query("gbt_attributions")
def q_gbt_attributions(spark, sf):
    """M7: what every feature adds to each hold-out prediction (exact Shapley values of the trees); with the
    expected value they sum to the prediction."""
    model, f, _ = _daily_model(spark, sf, "same_day")
    told = model.attribute(L.predict(model, f.filter("split = 'test'")))
    return told.select("user_id", "day", "prediction", "expected", "attributions.*")


@query("gbt_patience")
def q_gbt_patience(spark, sf):
    """M4 as in the notebook: boosting waits 50 rounds for a smaller error. The rows that tell it are the last
    fifth of each series' training rows, so the hold-out rows have no part in the choice; metrics on these."""
    f, _ = _daily_split(spark, sf)
    inner = kept(W.chrono_split(f.filter("split = 'train'").drop("split"), ts="day", series_cols=US), "daily-inner")
    model = L.fit_gbt(inner.filter("split = 'train'"), validation=inner.filter("split = 'test'"), features=_DAILY_X,
                      label="pm25_diff", patience=V.GBT_PATIENCE)
    return L.regression_metrics(L.predict(model, f.filter("split = 'test'")), label="pm25_diff", prediction="prediction") \
        .withColumn("n_trees", F.lit(model.n_trees))


_ROOT_X = ["hour", "dayofweek", "aqi", "ozone"]
_ROOT_SQL = f"""
SELECT 'hour' AS feature, CAST(hour(date) AS DOUBLE) AS x, y FROM r
UNION ALL SELECT 'dayofweek', CAST((dayofweek(date) + 6) % 7 AS DOUBLE), y FROM r
UNION ALL SELECT 'aqi', aqi, y FROM r UNION ALL SELECT 'ozone', ozone, y FROM r"""


@query("gbt_root_split", with_ctes("""
SELECT feature, x AS threshold, CAST(n_left AS BIGINT) AS n_left, round(gain, 4) AS gain,
       round(-(gl / n_left) * (n_left / (n_left + 1.0)), 6) AS left_value,
       round(-((g - gl) / (n - n_left)) * ((n - n_left) / (n - n_left + 1.0)), 6) AS right_value
FROM (SELECT *, gl * gl / (n_left + 1) + (g - gl) * (g - gl) / (n - n_left + 1) - g * g / (n + 1) AS gain FROM s
      WHERE n_left < n)
ORDER BY gain DESC LIMIT 1""", H=H_SQL, r="""
SELECT date, round(european_aqi / 5) * 5 AS aqi, round(ozone / 5) * 5 AS ozone, pm2_5 AS y FROM H
WHERE european_aqi IS NOT NULL AND ozone IS NOT NULL AND pm2_5 IS NOT NULL""", long=_ROOT_SQL,
    c="SELECT feature, x, sum((SELECT avg(y) FROM r) - y) AS g, count(*) AS n FROM long GROUP BY feature, x",
    s="""SELECT feature, x, sum(g) OVER w AS gl, sum(n) OVER w AS n_left, sum(g) OVER (PARTITION BY feature) AS g,
         sum(n) OVER (PARTITION BY feature) AS n FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)"""))
def q_gbt_root_split(spark, sf):
    """M4: the first split of a boosted model and the values of its two leaves, which a search of
    all thresholds of all features must find as well (features of few values, no shrinkage, one tree)."""
    r = station_hourly(spark, sf).select(
        F.hour("date").alias("hour"), F.weekday("date").alias("dayofweek"), (F.round(F.col("european_aqi") / 5) * 5).alias("aqi"),
        (F.round(F.col("ozone") / 5) * 5).alias("ozone"), "pm2_5").dropna()
    model = L.fit_gbt(r, features=_ROOT_X, label="pm2_5", maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0)
    nodes = model.nodes(spark)
    value = {n: nodes.filter(F.col("node") == n).select("value", "rows") for n in (1, 2)}
    left, right = (value[n].select(F.col("value").alias(f"v{n}"), F.col("rows").alias(f"r{n}"), F.lit(0).alias("node"))
                   for n in (1, 2))
    return nodes.filter("node = 0").join(left, "node").join(right, "node").select(
        "feature", "threshold", F.col("r1").alias("n_left"), F.round("gain", 4).alias("gain"),
        F.round("v1", 6).alias("left_value"), F.round("v2", 6).alias("right_value"))


# inputs of the two-target model: every feature but the targets and the current PM2.5 / index
_H_X = ["hour", "dayofweek", "hour_sin", "hour_cos", *[f"aqi_lag_{k}" for k in _HLAGS],
        *[f"pm2_5_lag_{k}" for k in _HLAGS], "rolling_aqi_mean",
        *[c for c in POLLUTANTS if c not in ("pm2_5", "european_aqi")]]


@query("gbt_two_targets")
def q_gbt_two_targets(spark, sf):
    """M5 + M6: one boosted model per target (t+1 PM2.5 and index) on the hourly station features, with all published
    rounds; hold-out = last ceil(0.3 n) rows; metrics and number of trees per target."""
    f = W.chrono_split(FT.features_hourly(station_hourly(spark, sf)), ts="date", test_share=0.3)
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    if train.isEmpty():
        raise ValueError(f"no complete hourly feature rows under {sf} to fit the models")
    out = None
    for target in ("target_pm25", "target_aqi"):
        m = L.fit_gbt(train, features=_H_X, label=target, **V.GBT_HOURLY)
        met = L.regression_metrics(L.predict(m, test), label=target, prediction="prediction") \
            .withColumns({"target": F.lit(target), "n_trees": F.lit(m.n_trees)})
        out = met if out is None else out.unionByName(met)
    return out


@query("importances")
def q_importances(spark, sf):
    """M7: feature importances of the daily model, largest first."""
    model, *_ = _daily_model(spark, sf, "same_day")
    rows = L.importances(model, _DAILY_X)
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


@query("forecast_next")
def q_forecast_next(spark, sf):
    """Next-day forecast of every series from its latest day (series whose
    latest day lacks an input get none); as served by the reference, the daily
    model's predicted change is added to today's value."""
    model, _, feats = _daily_model(spark, sf, "same_day")
    return L.forecast_next(model, feats, features=_DAILY_X, series_cols=US)


@query("forecast_next_day")
def q_forecast_next_day(spark, sf):
    """M10 with the model trained on the next day's change (``target="next_day"``), which is what
    the forecast adds to today's value."""
    model, _, feats = _daily_model(spark, sf, "next_day")
    return L.forecast_next(model, feats, features=_DAILY_X, series_cols=US)


@query("backtest_gbt")
def q_backtest_gbt(spark, sf):
    """M11 with the daily model: last 7 days of every series, predicted = current + delta."""
    model, *_ = _daily_model(spark, sf, "same_day")
    rows = L.backtest_rows(_daily_filled(spark, sf), series_cols=US, value_cols=POLLUTANTS)
    pred = L.predict(model, rows)
    return L.backtest_metrics(pred, series_cols=US, delta="prediction")


_PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pca3")
def q_pca3(spark, sf):
    """M8 (+W12): standardised PCA(3) of the line items: loadings, variance
    ratios, cumulative ratio."""
    comps, _ = L.pca(table(spark, sf, "lineitem"), _PCA_COLS, k=3)
    return comps


@query("pca_reconstruction", "\nUNION ALL\n".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, round({corr(a, b)}, 6) AS reconstructed, {1.0 if a == b else 0.0} AS dot
FROM lineitem""" for a in _PCA_COLS for b in _PCA_COLS))
def q_pca_reconstruction(spark, sf):
    """M8: variances and loadings of all components give the correlations back (sum of variance x loading x loading),
    and the components' unit vectors stand at right angles (dot products over components)."""
    comps, _ = L.pca(table(spark, sf, "lineitem"), _PCA_COLS, k=len(_PCA_COLS))
    a = comps.select("component", "variance", F.col("feature").alias("col_a"), F.col("loading").alias("x"))
    b = comps.select("component", F.col("feature").alias("col_b"), F.col("loading").alias("y"))
    return a.join(b, "component").groupBy("col_a", "col_b").agg(
        F.round(F.sum(F.col("variance") * F.col("x") * F.col("y")), 6).alias("reconstructed"),
        F.round(F.abs(F.round(F.sum(F.col("x") * F.col("y")), 9)), 6).alias("dot"))


@query("pca_projection")
def q_pca_projection(spark, sf):
    """M8: every line item projected on the three components."""
    _, proj = L.pca(table(spark, sf, "lineitem"), _PCA_COLS, k=3)
    return proj.select("l_orderkey", "l_linenumber", "pc1", "pc2", "pc3")


@query("anomalies")
def q_anomalies(spark, sf):
    """M9 (+J4, P13): isolation-forest score and 5 % flag on every line item."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_PCA_COLS)
    return iforest.anomalies(li, _PCA_COLS, ["l_orderkey", "l_linenumber"])


# --- what SQL can say about the models: their rows, inputs and sizes ----------------

@query("holdout_actuals", with_ctes(f"""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, pm25_diff AS actual FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k, count(*) OVER (PARTITION BY user_id) AS n
  FROM fx WHERE {_COMPLETE}) WHERE k > floor(n * 0.8)""", **_CTES))
def q_holdout_actuals(spark, sf):
    """Keys and actual values of the rows that the daily model is tested on."""
    f = W.chrono_split(_features_daily(spark, sf), ts="day", series_cols=US)
    return f.filter("split = 'test'").select("user_id", "day", F.col("pm25_diff").alias("actual"))


@query("forecast_inputs", with_ctes(f"""
SELECT user_id, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS date_prevision, {rnd('pm2_5', 2)} AS current_pm25
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM fx)
WHERE k = 1 AND {' AND '.join(f'{c} IS NOT NULL' for c in _DAILY_X)}""", **_CTES))
def q_forecast_inputs(spark, sf):
    """The series that get a forecast, its date and the current value."""
    feats = FT.daily_features(_daily_filled(spark, sf), series_cols=US, drop_incomplete=False)
    latest = C.complete_rows(W.last_n(feats, ts="day", n=1, series_cols=US), _DAILY_X)
    return latest.select("user_id", F.date_format(F.date_add("day", 1), "yyyy-MM-dd").alias("date_prevision"),
                         rounded("pm2_5", 2).alias("current_pm25"))


@query("backtest_pairs", with_ctes("SELECT user_id, pm2_5, actual FROM bt", **_CTES, bt=_BT))
def q_backtest_pairs(spark, sf):
    """The (current, actual) pairs that every model is back-tested on."""
    return L.backtest_rows(_daily_filled(spark, sf), series_cols=US, value_cols=POLLUTANTS) \
        .select("user_id", "pm2_5", "actual")


@query("two_target_rows", _TWO_TARGET_ROWS)
def q_two_target_rows(spark, sf):
    """M5: rows and target means of both parts of the 70/30 split of the hourly features."""
    f = W.chrono_split(FT.features_hourly(station_hourly(spark, sf)), ts="date", test_share=0.3)
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("target_pm25").alias("pm25_mean"),
                                  F.avg("target_aqi").alias("aqi_mean"))


@query("pca_moments", "\nUNION ALL\n".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, avg({a}) AS mean_a, stddev_samp({a}) AS sd_a,
       covar_samp({a}, {b}) AS covariance FROM lineitem
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _PCA_COLS)}""" for a in _PCA_COLS for b in _PCA_COLS))
def q_pca_moments(spark, sf):
    """M8: the means, deviations and covariances that the components are computed from."""
    return L.moments(table(spark, sf, "lineitem"), _PCA_COLS)


@query("forest_size", f"""
SELECT count(*) AS complete_rows, least({V.IFOREST_SAMPLE}, count(*)) AS rows_per_tree,
       CAST({V.IFOREST_TREES} AS BIGINT) AS trees FROM lineitem
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _PCA_COLS)}""")
def q_forest_size(spark, sf):
    """M9: complete rows, and the rows that every tree of the fitted forest grew on."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_PCA_COLS)
    model = iforest.fit(li, _PCA_COLS, ["l_orderkey", "l_linenumber"])
    sizes = {int(t[4][0]) for t in model.trees}
    return C.complete_rows(li, _PCA_COLS).agg(F.count(F.lit(1)).alias("complete_rows")).select(
        "complete_rows", F.lit(max(sizes) if len(sizes) == 1 else -1).cast("long").alias("rows_per_tree"),
        F.lit(len(model.trees)).cast("long").alias("trees"))
