"""Feature tables for the forecasting models.

Each is one composition over a single per-series sort: Catalyst collapses the
lag / lead / rolling expressions that share ``partitionBy(series).orderBy(ts)``
into one Window operator over one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import cyclic, weekday
from . import windows as W
from .resample import daily_resample
from .stats import drop_sparse

DAILY_FEATURES = ["pm25_lag_1", "co_lag_1", "pm25_lag_2", "co_lag_2", "pm25_lag_3", "co_lag_3",
                  "pm25_rolling_7d", "day_of_week", "month"]


def daily_table(hourly: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
                series_cols: Sequence[str] = (), sparse_cols: Sequence[str] = ("formaldehyde",),
                max_null_share: float = 0.5, as_of: str | None = None) -> DataFrame:
    """A2 -> P15 -> W7: daily calendar means, sparse columns dropped, the rest
    interpolated (positional, forward). ``as_of`` drops rows stamped later (D4)."""
    daily = daily_resample(hourly, ts=ts, value_cols=value_cols, series_cols=series_cols,
                           as_of=as_of)
    sparse = [c for c in sparse_cols if c in daily.columns]
    if sparse:
        daily = drop_sparse(daily, sparse, max_null_share)
    keep = [c for c in value_cols if c in daily.columns]
    return W.interpolate(daily, ts="day", cols=keep, series_cols=series_cols)


def daily_features(filled: DataFrame, *, series_cols: Sequence[str] = (), pm: str = "pm2_5",
                   co: str = "carbon_monoxide", target: str = "same_day",
                   drop_incomplete: bool = True) -> DataFrame:
    """M1 features on an interpolated daily table.

    ``target="same_day"``: ``pm25_diff = pm_t - pm_{t-1}`` (as trained by the
    reference; equals pm2_5 - pm25_lag_1 on every row). ``"next_day"``:
    ``pm_{t+1} - pm_t``, the change the forecast is used for.
    """
    w = W.series_window(series_cols, "day")
    x = F.col(pm)
    cols = {}
    if target == "next_day":
        cols["pm25_diff"] = F.lead(x, 1).over(w) - x
    else:
        cols["pm25_diff"] = x - F.lag(x, 1).over(w)
    for i in range(1, 4):
        cols[f"pm25_lag_{i}"] = F.lag(x, i).over(w)
        cols[f"co_lag_{i}"] = F.lag(F.col(co), i).over(w)
    cols["pm25_rolling_7d"] = W.rolling_mean_expr(w, pm, 7)
    cols["day_of_week"] = weekday("day")
    cols["month"] = F.month("day")
    out = filled.withColumns(cols)
    return out.dropna() if drop_incomplete else out


def features_daily(hourly: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
                   series_cols: Sequence[str] = (), target: str = "same_day", **kw) -> DataFrame:
    """M1: A2 -> P15 -> W7 -> W3, W1 x 6, W4, weekday, month -> dropna."""
    filled = daily_table(hourly, ts=ts, value_cols=value_cols, series_cols=series_cols, **kw)
    return daily_features(filled, series_cols=series_cols, target=target)


def _with_windows(df: DataFrame, build, *, ts: str, series_cols: Sequence[str], back: int,
                  ahead: int, block_rows: int | None) -> DataFrame:
    """Window columns per series, or per block with edge repair for raw
    series too long for one task (same values)."""
    if block_rows:
        from .blocked import bounded
        return bounded(df, ts=ts, build=build, back=back, ahead=ahead, series_cols=series_cols,
                       block_rows=block_rows)
    return df.withColumns(build(W.series_window(series_cols, ts)))


def features_hourly(df: DataFrame, *, ts: str = "date", series_cols: Sequence[str] = (),
                    aqi: str = "european_aqi", pm: str = "pm2_5",
                    lags: Sequence[int] = (1, 3, 6, 12, 24),
                    block_rows: int | None = None) -> DataFrame:
    """M2: hour, weekday, cyclic hour, index and PM lags, previous-6 mean of the
    index, t+1 targets, rows with any null removed."""
    def build(w):
        cols = {f"aqi_lag_{k}": F.lag(aqi, k).over(w) for k in lags}
        cols.update({f"pm2_5_lag_{k}": F.lag(pm, k).over(w) for k in lags})
        cols["rolling_aqi_mean"] = W.rolling_mean_expr(w, aqi, 6, shift=1)
        cols["target_pm25"] = F.lead(pm, 1).over(w)
        cols["target_aqi"] = F.lead(aqi, 1).over(w)
        return cols

    s, c = cyclic(F.hour(ts), 24.0)
    base = df.withColumns({"hour": F.hour(ts), "dayofweek": weekday(ts), "hour_sin": s,
                           "hour_cos": c})
    out = _with_windows(base, build, ts=ts, series_cols=series_cols, back=max(max(lags), 7),
                        ahead=1, block_rows=block_rows)
    return out.dropna()


REDUCED_DROP = V.REDUCED_DROP


def features_reduced(df: DataFrame, *, ts: str = "date", series_cols: Sequence[str] = (),
                     aqi: str = "european_aqi", pm: str = "pm2_5",
                     drop: Sequence[str] = tuple(REDUCED_DROP),
                     block_rows: int | None = None) -> DataFrame:
    """M3: drop listed columns, cyclic hour, index lags 1,3,6,24, PM lags 1,3,24,
    t+1 targets; the hour itself is not kept; rows with any null removed."""
    def build(w):
        cols = {f"aqi_lag_{k}": F.lag(aqi, k).over(w) for k in (1, 3, 6, 24)}
        cols.update({f"pm2_5_lag_{k}": F.lag(pm, k).over(w) for k in (1, 3, 24)})
        cols["target_pm25"] = F.lead(pm, 1).over(w)
        cols["target_aqi"] = F.lead(aqi, 1).over(w)
        return cols

    s, c = cyclic(F.hour(ts), 24.0)
    base = df.drop(*[c for c in drop if c in df.columns]).withColumns({"hour_sin": s, "hour_cos": c})
    return _with_windows(base, build, ts=ts, series_cols=series_cols, back=24, ahead=1,
                         block_rows=block_rows).dropna()
