"""Metrics, back-test, retrain decision, boosted trees, PCA, forecast
(M4-M8, M10-M13, W12).

Trees are fitted by ``boosting`` (aggregated histograms); everything around them --
features, metrics, back-test selection, decisions -- is plain DataFrame code. Only model parameters (a few numbers per feature or
component) are read on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import level4, level4_advice, rounded
from . import boosting
from . import windows as W
from .features import DAILY_FEATURES, daily_features


def regression_metrics(df: DataFrame, *, label: str, prediction: str,
                       series_cols: Sequence[str] = ()) -> DataFrame:
    """M6: MSE, RMSE, MAE, R^2 (1 - SSE/SST; NULL when SST is 0), n."""
    y, p = F.col(label), F.col(prediction)
    pairs = df.filter(y.isNotNull() & p.isNotNull())
    err = y - p
    out = pairs.groupBy(*series_cols).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.count(F.lit(1)).alias("n"))
    return out.select(*series_cols, "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("r2"),
                      "n")


def backtest_rows(filled: DataFrame, *, series_cols: Sequence[str] = (), pm: str = "pm2_5",
                  value_cols: Sequence[str], last: int = 7, min_index: int = 7,
                  flag: str | None = None) -> DataFrame:
    """M11 row selection without a loop.

    For each of the last ``last`` days d of a series (0-based index >= ``min_index``),
    the input is the feature row of day d-1 and the actual value is pm at d.
    Lags and rolling means only look back, so features computed once over the
    whole series equal features computed on every prefix. Rows whose inputs hold
    a NULL are skipped. With ``flag``, all days come back and that column tells the
    selected ones, so that other figures can be taken from the same rows.
    """
    feats = daily_features(filled, series_cols=series_cols, pm=pm, drop_incomplete=False)
    w = W.series_window(series_cols, "day")
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_cols))
    staged = feats.withColumns({"_idx": F.row_number().over(w), "_n": n,
                                "actual": F.lead(pm, 1).over(w)})
    inputs = [*value_cols, *DAILY_FEATURES]
    complete = F.lit(True)
    for c in inputs:
        complete = complete & F.col(c).isNotNull()
    # target index (0-based) = _idx; it must exist, be >= min_index, and be among the last days
    keep = ((F.col("_idx") <= F.col("_n") - 1) & (F.col("_idx") >= min_index) &
            (F.col("_idx") >= F.col("_n") - last) & complete)
    if flag:
        return staged.withColumn(flag, F.coalesce(keep, F.lit(False))).drop("_idx", "_n")
    return staged.filter(keep).drop("_idx", "_n")


def backtest_metrics(rows: DataFrame, *, series_cols: Sequence[str] = (), pm: str = "pm2_5",
                     delta: str | None = None) -> DataFrame:
    """M11 metrics: predicted = current + predicted delta (0 for the naive
    persistence forecast); MAE, RMSE, n per series."""
    pred = F.col(pm) + (F.col(delta) if delta else F.lit(0.0))
    err = F.col("actual") - pred
    return rows.groupBy(*series_cols).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.count(F.lit(1)).alias("n_samples"))


def _two_digits(c):
    return F.translate(F.format_number(c, 2), ",", "")


def mae_threshold(baseline: dict | None) -> float | None:
    """The MAE above which a model is retrained: max(1.5 x baseline MAE, 5); None without a baseline.

    A baseline that lacks the PM2.5 error counts as 2.0.
    """
    if not baseline:
        return None
    base = baseline.get("mae_pm25", V.RETRAIN_DEFAULT_BASELINE)
    return max(base * V.RETRAIN_FACTOR, V.RETRAIN_FLOOR)


def _reason_perf(mae, threshold: float):
    """The fixed reason text with both numbers to two digits."""
    before, _, after = V.REASON_PERF.format(mae="\0", thr=f"{threshold:.2f}").partition("\0")
    return F.concat(F.lit(before), _two_digits(mae), F.lit(after))


def decide(rows: DataFrame, *, mae: str = "mae", null_share: str = "pm25_null_share",
           baseline: dict | None = V.BASELINE_METRICS) -> DataFrame:
    """M12 on rows that hold a back-test error and a PM2.5 null share: adds the threshold, the
    decision and its reasons.

    The error decides only if there is both a back-test and a baseline. A null share above 10 %
    adds a reason but does not set the flag.
    """
    thr = mae_threshold(baseline)
    perf = F.lit(False) if thr is None else F.coalesce(F.col(mae) > thr, F.lit(False))
    reasons = [] if thr is None else [F.when(perf, _reason_perf(F.col(mae), thr))]
    reasons.append(F.when(F.col(null_share) > V.RETRAIN_NULL_SHARE, F.lit(V.REASON_NULLS)))
    return rows.select("*", F.lit(thr).cast("double").alias("mae_threshold"), perf.alias("needs_retraining"),
                       F.array_compact(F.array(*reasons)).alias("reasons"))


def retrain_decision(metrics: DataFrame, null_share: DataFrame, *, series_cols: Sequence[str] = (),
                     baseline: dict | None = V.BASELINE_METRICS) -> DataFrame:
    """M12 for metrics and null shares held in two frames (``null_share`` has one row per series
    with column ``pm25_null_share``; a series without metrics is never flagged for performance)."""
    j = null_share.join(metrics, list(series_cols), "left") if series_cols else \
        null_share.select("*", *[metrics.select(c).scalar().alias(c) for c in ("mae",)])
    return decide(j, baseline=baseline).select(*series_cols, "mae", "mae_threshold", "needs_retraining", "reasons")


def monitoring_report(quality: DataFrame, performance: DataFrame, *, baseline: dict | None = V.BASELINE_METRICS,
                      now=None, pm: str = "pm2_5") -> DataFrame:
    """The one nested record of the monitoring: time, data quality (A15), back-test
    performance (null without samples), baseline, decision and reasons.

    ``quality`` has one row (``stats.dq_report``), ``performance`` at most one (``backtest_metrics``);
    they are joined on a constant, so the record is made where the numbers are.
    """
    one = F.lit(1).alias("_one")
    q = quality.select(one, F.struct(*[F.col(c) for c in quality.columns]).alias("data_quality"),
                       F.coalesce(F.col(f"missing_values_pct.{pm}"), F.lit(0.0)).alias("_share"))
    p = performance.filter("n_samples > 0").select(
        one, F.struct("mae", "rmse", "n_samples").alias("performance"), F.col("mae").alias("_mae"))
    rows = decide(q.join(p, "_one", "left"), mae="_mae", null_share="_share", baseline=baseline)
    base = F.struct(*[F.lit(float(v)).alias(k) for k, v in sorted(baseline.items())]) if baseline \
        else F.lit(None).cast("struct<mae_pm25:double>")
    stamp = F.current_timestamp() if now is None else now
    return rows.select(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"), "data_quality",
                       "performance", base.alias("baseline_comparison"), "needs_retraining", "reasons")


# --- boosted trees -------------------------------------------------------------

def fit_gbt(train: DataFrame, *, features: Sequence[str], label: str, seed: int = 42,
            validation: DataFrame | None = None, **params) -> boosting.Boosted:
    """M4/M5: squared-error boosted trees, by default with the published settings of the daily model.

    All ``maxIter`` rounds are grown; only with a ``patience`` do rows of ``validation`` stop the
    fit, after so many rounds without gain, and choose the number of trees.
    """
    return boosting.fit(train, features=features, label=label, seed=seed, validation=validation,
                        **{**V.GBT_DAILY, **params})


saved_fit = boosting.saved_fit


def predict(model: boosting.Boosted, df: DataFrame) -> DataFrame:
    """Model output (``prediction``) next to the inputs."""
    return model.predict(df)


def importances(model: boosting.Boosted, features: Sequence[str], top_n: int | None = None, kind: str = "gain"):
    """M7: feature importances (mean gain of a feature's splits, as shares), largest first."""
    found = model.importances(kind)
    rows = sorted(((f, found[f]) for f in features), key=lambda r: (-r[1], r[0]))
    return rows[:top_n] if top_n else rows


def forecast_next(model: boosting.Boosted, feats: DataFrame, *, features: Sequence[str],
                  series_cols: Sequence[str] = (), pm: str = "pm2_5",
                  digits: int | None = 2) -> DataFrame:
    """Latest day of each series -> predicted change -> next day's value,
    label and advice.

    ``feats`` holds every day (incomplete rows included): the forecast is made
    from the latest day only, and a series whose latest day misses an input
    gets no forecast (the service refuses such a request; an older day is never
    used instead).
    """
    from .columns import complete_rows
    latest = complete_rows(W.last_n(feats, ts="day", n=1, series_cols=series_cols), features)
    out = predict(model, latest)
    predicted = F.col(pm) + F.col("prediction")
    return out.select(*series_cols,
                      F.date_format(F.date_add("day", 1), "yyyy-MM-dd").alias("date_prevision"),
                      rounded(F.col(pm), digits).alias("current_pm25"),
                      rounded(predicted, digits).alias("predicted_pm25"),
                      rounded(F.col("prediction"), digits).alias("delta"),
                      level4(predicted).alias("aqi_label"), level4_advice(predicted).alias("conseil"))


# --- principal components ------------------------------------------------------

def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M8 input: sample covariance, means and standard deviations of every pair of columns over
    complete rows, in one aggregation: (col_a, col_b, n, mean_a, sd_a, covariance)."""
    rows = df.dropna(subset=list(cols))
    x = {c: F.col(c).cast("double") for c in cols}
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        exprs += [F.avg(x[a]).alias(f"m__{a}"), F.stddev_samp(x[a]).alias(f"s__{a}")]
        exprs += [F.covar_samp(x[a], x[b]).alias(f"c__{a}__{b}") for b in cols[i:]]
    one = rows.agg(*exprs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            first, second = (a, b) if i <= j else (b, a)
            cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col("n"),
                                  F.col(f"m__{a}").alias("mean_a"), F.col(f"s__{a}").alias("sd_a"),
                                  F.col(f"c__{first}__{second}").alias("covariance")))
    return one.select(F.inline(F.array(*cells)))


def pca(df: DataFrame, cols: Sequence[str], k: int = 3):
    """M8: standardise (mean 0, unit variance) + PCA(k) over complete rows.

    One aggregation gives means and covariances; the eigenproblem of the small
    correlation matrix is solved on the driver, and rows are projected with
    plain column arithmetic. A constant column is 0 after standardising.

    Returns (components frame, projected rows). Components carry the variance
    ratio, the raw variance (ratio x number of standardised columns), the
    cumulative ratio (W12) and the loadings, sign-fixed so the largest loading
    of each component is positive.
    """
    spark = df.sparkSession
    cols = list(cols)
    found = {(r["col_a"], r["col_b"]): r for r in moments(df, cols).collect()}   # len(cols)^2 rows
    mean = [found[c, c]["mean_a"] for c in cols]
    sd = [found[c, c]["sd_a"] or 0.0 for c in cols]
    corr = np.array([[(found[a, b]["covariance"] or 0.0) / (sd[i] * sd[j]) if sd[i] and sd[j] else 0.0
                      for j, b in enumerate(cols)] for i, a in enumerate(cols)])
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1][:k]
    total = float(values.sum())
    recs, ratios, signed = [], [], []
    for j, at in enumerate(order):
        v = vectors[:, at]
        v = v if v[np.abs(v).argmax()] >= 0 else -v
        signed.append(v)
        ratios.append(float(values[at]) / total if total else 0.0)
        recs += [(j + 1, c, float(v[i]), ratios[-1], float(values[at])) for i, c in enumerate(cols)]
    loads = spark.createDataFrame(recs, "component int, feature string, loading double, "
                                        "variance_ratio double, variance double")
    var = spark.createDataFrame([(j + 1, r) for j, r in enumerate(ratios)],
                                "component int, variance_ratio double")
    cum = W.cumulative_sum(var, order_col="component", col="variance_ratio",
                           out="cumulative_ratio").drop("variance_ratio")
    comps = loads.join(cum, "component")
    std = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for c, m, s in zip(cols, mean, sd)]
    proj = df.dropna(subset=cols).select("*", *[
        sum((z * F.lit(float(v[i])) for i, z in enumerate(std)), F.lit(0.0)).alias(f"pc{j + 1}")
        for j, v in enumerate(signed)])
    return comps, proj
