"""Ordered per-series operators and the flagship (phase 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import level3
from ..operators import profiles as P
from ..operators import resample as R
from ..operators import windows as W
from .registry import query
from .sqltext import day_txt, interp_select, rolling_mean, ts_txt, win
from .standins import H_SQL, POLLUTANTS, U_SQL, station_hourly, users_hourly, with_ctes

US = ["user_id"]
_LAGS = {"pm2_5": [1, 3, 6, 12, 24], "european_aqi": [1, 3, 6, 12, 24]}


def _lag_sql(series, order="date"):
    w = win(series, order)
    return ", ".join(f"lag({c}, {k}) {w} AS {c}_lag_{k}" for c, ks in _LAGS.items() for k in ks)


@query("lags", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, pm2_5, european_aqi, {_lag_sql(US)} FROM U""", U=U_SQL))
def q_lags(spark, sf):
    """Hourly lags 1, 3, 6, 12, 24 of two columns per series, one sort."""
    u = users_hourly(spark, sf).select("user_id", "date", "pm2_5", "european_aqi")
    return W.add_lags(u, ts="date", lags=_LAGS, series_cols=US)


@query("lead_target", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, lead(pm2_5, 1) {win(US, 'date')} AS target_pm25,
       lead(european_aqi, 1) {win(US, 'date')} AS target_aqi FROM U""", U=U_SQL))
def q_lead_target(spark, sf):
    """t+1 targets per series."""
    u = users_hourly(spark, sf)
    u = W.add_lead(u, ts="date", col="pm2_5", out="target_pm25", series_cols=US)
    u = W.add_lead(u, ts="date", col="european_aqi", out="target_aqi", series_cols=US)
    return u.select("user_id", "date", "target_pm25", "target_aqi")


@query("first_diff", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, pm2_5 - lag(pm2_5, 1) {win(US, 'date')} AS pm25_diff
FROM U""", U=U_SQL))
def q_first_diff(spark, sf):
    """First difference per series."""
    u = users_hourly(spark, sf)
    return W.first_diff(u, ts="date", col="pm2_5", out="pm25_diff", series_cols=US) \
        .select("user_id", "date", "pm25_diff")


@query("rolling_full", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, {rolling_mean('pm2_5', US, 'date', 7)} AS pm25_rolling_7
FROM U""", U=U_SQL))
def q_rolling_full(spark, sf):
    """Mean of the last 7 rows, all 7 required."""
    return W.add_rolling_mean(users_hourly(spark, sf), ts="date", col="pm2_5", out="pm25_rolling_7",
                              n=7, series_cols=US).select("user_id", "date", "pm25_rolling_7")


@query("rolling_min1", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, {rolling_mean('pm2_5', US, 'date', 24, 1)} AS pm25_r24
FROM U""", U=U_SQL))
def q_rolling_min1(spark, sf):
    """Mean of the last 24 rows, one value suffices."""
    return W.add_rolling_mean(users_hourly(spark, sf), ts="date", col="pm2_5", out="pm25_r24",
                              n=24, min_periods=1, series_cols=US).select("user_id", "date", "pm25_r24")


@query("lagged_rolling", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date,
       {rolling_mean('european_aqi', US, 'date', 6, None, 1)} AS rolling_aqi_mean FROM U""", U=U_SQL))
def q_lagged_rolling(spark, sf):
    """Mean of the previous 6 rows (current row excluded), all 6 required."""
    return W.add_rolling_mean(users_hourly(spark, sf), ts="date", col="european_aqi",
                              out="rolling_aqi_mean", n=6, shift=1, series_cols=US) \
        .select("user_id", "date", "rolling_aqi_mean")


_UD = f"""SELECT user_id, CAST(date AS DATE) AS day, {', '.join(f'avg({c}) AS {c}' for c in POLLUTANTS)}
FROM U GROUP BY 1, 2"""
_CAL = """SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)"""
_UDAILY = f"""SELECT c.user_id, c.day, {', '.join(f'd.{c}' for c in POLLUTANTS)}
FROM cal c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day"""


@query("interpolate", with_ctes(
    f"SELECT user_id, {day_txt('day')} AS day, {', '.join(POLLUTANTS)} FROM i",
    U=U_SQL, d=_UD, cal=_CAL, ud=_UDAILY,
    i=interp_select(POLLUTANTS, US, "day", "ud", ["user_id", "day"])))
def q_interpolate(spark, sf):
    """W7 on the per-series daily calendar (A2): positional, forward only."""
    daily = R.daily_resample(users_hourly(spark, sf), ts="date", value_cols=POLLUTANTS,
                             series_cols=US)
    return W.interpolate(daily, ts="day", cols=POLLUTANTS, series_cols=US)


_ISL = f"""SELECT date, european_aqi, bad,
       sum(chg) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
FROM (SELECT *, CAST(coalesce(bad <> lag(bad) OVER (ORDER BY date), true) AS INTEGER) AS chg
      FROM (SELECT date, european_aqi, CAST(european_aqi > 60 AS INTEGER) AS bad
            FROM H WHERE european_aqi IS NOT NULL))"""


@query("islands", with_ctes(f"""
SELECT {ts_txt('date')} AS date, european_aqi, bad, CAST(episode AS BIGINT) AS episode FROM isl""",
                            H=H_SQL, isl=_ISL))
def q_islands(spark, sf):
    """Run ids of index > 60 on the station series (nulls removed first)."""
    h = station_hourly(spark, sf).select("date", "european_aqi")
    return W.islands(h, ts="date", col="european_aqi", threshold=V.EPISODE_THRESHOLD)


@query("episodes", with_ctes("""
SELECT CAST(episode AS BIGINT) AS episode, strftime(arg_min(date, date), '%Y-%m-%d') AS debut,
       strftime(arg_max(date, date), '%Y-%m-%d') AS fin, count(*) AS duree,
       max(european_aqi) AS aqi_max, avg(european_aqi) AS aqi_moy
FROM isl WHERE bad = 1 GROUP BY episode HAVING count(*) >= 6""", H=H_SQL, isl=_ISL))
def q_episodes(spark, sf):
    """Runs of index > 60 lasting at least 6 rows."""
    return W.episodes(station_hourly(spark, sf), ts="date", col="european_aqi")


@query("last_n", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, {', '.join(POLLUTANTS)} FROM U
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 10""", U=U_SQL))
def q_last_n(spark, sf):
    """L2: latest 10 rows per series."""
    return W.last_n(users_hourly(spark, sf), ts="date", n=10, series_cols=US)


_HD = f"""SELECT CAST(date AS DATE) AS day, avg(pm2_5) AS pm2_5 FROM H GROUP BY 1"""
_HCAL = """SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM hd"""


@query("history7", with_ctes("""
SELECT strftime(c.day, '%Y-%m-%d') AS dates, hd.pm2_5 AS "values"
FROM hcal c LEFT JOIN hd ON c.day = hd.day ORDER BY c.day DESC LIMIT 7""",
                             H=H_SQL, hd=_HD, hcal=_HCAL))
def q_history7(spark, sf):
    """Seven latest days of the daily mean on a full calendar."""
    daily = R.daily_resample(station_hourly(spark, sf), ts="date", value_cols=["pm2_5"])
    return W.history(daily, day_col="day", col="pm2_5", n=7)


@query("peaks", with_ctes("""
SELECT strftime(date, '%Y-%m-%d') AS date_str, max(european_aqi) AS european_aqi
FROM H WHERE european_aqi > 60 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", H=H_SQL))
def q_peaks(spark, sf):
    """15 days with the highest daily maximum above 60 (top-n report)."""
    return P.peaks(station_hourly(spark, sf))


@query("rolling_daily", with_ctes(f"""
SELECT date_str, avg(pm2_5_r) AS pm2_5_r, avg(pm10_r) AS pm10_r, avg(ozone_r) AS ozone_r
FROM (SELECT strftime(date, '%Y-%m-%d') AS date_str,
             {rolling_mean('pm2_5', [], 'date', 24, 1)} AS pm2_5_r,
             {rolling_mean('pm10', [], 'date', 24, 1)} AS pm10_r,
             {rolling_mean('ozone', [], 'date', 24, 1)} AS ozone_r FROM H)
GROUP BY 1""", H=H_SQL))
def q_rolling_daily(spark, sf):
    """24-row rolling means (min 1), then their daily mean."""
    return W.rolling_daily(station_hourly(spark, sf), cols=["pm2_5", "pm10", "ozone"])


@query("band", with_ctes("""
SELECT strftime(day, '%Y-%m-%d') AS day, value, bound, seq FROM (
  SELECT day, mx AS value, 'max' AS bound, row_number() OVER (ORDER BY day) AS seq FROM dm
  UNION ALL
  SELECT day, mn AS value, 'min' AS bound,
         (SELECT count(*) FROM dm) + row_number() OVER (ORDER BY day DESC) AS seq FROM dm)""",
    H=H_SQL, dm="SELECT CAST(date AS DATE) AS day, max(ozone) AS mx, min(ozone) AS mn FROM H GROUP BY 1"))
def q_band(spark, sf):
    """Daily max curve followed by the reversed daily min curve."""
    h = station_hourly(spark, sf).withColumn("day", F.to_date("date"))
    mx = h.groupBy("day").agg(F.max("ozone").alias("value"))
    mn = h.groupBy("day").agg(F.min("ozone").alias("value"))
    return W.band(mx, mn, day_col="day", value_col="value")


@query("pivot_heatmap", with_ctes(f"""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS dayofweek,
       {', '.join(f'avg(CASE WHEN hour(date) = {h} THEN pm2_5 END) AS h{h}' for h in range(24))}
FROM H GROUP BY 1""", H=H_SQL))
def q_pivot_heatmap(spark, sf):
    """Weekday x hour mean of PM2.5."""
    return P.weekday_hour_pivot(station_hourly(spark, sf), value_col="pm2_5")


_FLAG = {"pm2_5": [1, 2, 3], "carbon_monoxide": [1, 2, 3]}
_HDAILY = f"""SELECT CAST(date AS DATE) AS day, {', '.join(f'avg({c}) AS {c}' for c in POLLUTANTS)}
FROM H GROUP BY 1"""
_HCAL2 = """SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM hd"""
_HFULL = f"""SELECT c.day, {', '.join(f'hd.{c}' for c in POLLUTANTS)} FROM hcal c LEFT JOIN hd ON c.day = hd.day"""


def _flagship_sql():
    w = win([], "day")
    lags = ", ".join(f"lag({c}, {k}) {w} AS {'pm25' if c == 'pm2_5' else 'co'}_lag_{k}"
                     for c, ks in _FLAG.items() for k in ks)
    lv = ("CASE WHEN pm2_5 <= 12.0 THEN 'Bon' WHEN pm2_5 <= 35.5 THEN 'Moyen' ELSE 'Mauvais' END")
    return with_ctes(f"""
SELECT strftime(day, '%Y-%m-%d') AS day, {', '.join(POLLUTANTS)}, {lags},
       {rolling_mean('pm2_5', [], 'day', 7)} AS pm25_rolling_7d, {lv} AS aqi_level
FROM i""", H=H_SQL, hd=_HDAILY, hcal=_HCAL2, hfull=_HFULL,
                     i=interp_select(POLLUTANTS, [], "day", "hfull", ["day"]))


def flagship(spark, sf):
    h = station_hourly(spark, sf)
    daily = R.daily_resample(h, ts="date", value_cols=POLLUTANTS)
    filled = W.interpolate(daily, ts="day", cols=POLLUTANTS)
    feats = W.add_lags(filled, ts="day", lags=_FLAG, pattern="{c}_lag_{k}") \
        .withColumnsRenamed({f"{c}_lag_{k}": f"{'pm25' if c == 'pm2_5' else 'co'}_lag_{k}"
                             for c, ks in _FLAG.items() for k in ks})
    feats = W.add_rolling_mean(feats, ts="day", col="pm2_5", out="pm25_rolling_7d", n=7)
    return feats.withColumn("aqi_level", level3("pm2_5"))


query("flagship", _flagship_sql())(flagship)


# --- raw (unaggregated) series through the skew-safe blocked windows ------------

from ..operators import blocked as B  # noqa: E402
from .sqltext import win as _win  # noqa: E402
from .standins import table as _table  # noqa: E402

_RAW_W = _win(US, "ts, event_id")


def _raw_events(spark, sf):
    return _table(spark, sf, "events").select(
        "user_id", "ts", "event_id", "value",
        F.when(F.col("event_type") == "click", F.col("value")).alias("click_value"))


@query("lags_raw", f"""
SELECT user_id, event_id, lag(value, 1) {_RAW_W} AS value_lag_1, lag(value, 3) {_RAW_W} AS value_lag_3,
       lead(value, 1) {_RAW_W} AS value_next,
       avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value_r4
FROM events""")
def q_lags_raw(spark, sf):
    """W1/W2/W5 on raw event rows per series, computed in blocks with
    edge repair (no series is held by one task)."""
    def build(w):
        return {"value_lag_1": F.lag("value", 1).over(w), "value_lag_3": F.lag("value", 3).over(w),
                "value_next": F.lead("value", 1).over(w),
                "value_r4": W.rolling_mean_expr(w, "value", 4, 1)}
    out = B.bounded(_raw_events(spark, sf), ts="ts", build=build, back=3, ahead=1,
                    series_cols=US, tiebreak=["event_id"])
    return out.select("user_id", "event_id", "value_lag_1", "value_lag_3", "value_next", "value_r4")


@query("interpolate_raw", with_ctes(
    "SELECT user_id, event_id, click_value FROM i",
    r="SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS click_value FROM events",
    i=interp_select(["click_value"], US, "ts, event_id", "r", ["user_id", "event_id"])))
def q_interpolate_raw(spark, sf):
    """W7 on raw event rows (click values only known), in blocks."""
    out = B.interpolate(_raw_events(spark, sf), ts="ts", cols=["click_value"], series_cols=US,
                        tiebreak=["event_id"])
    return out.select("user_id", "event_id", "click_value")


@query("islands_raw", f"""
SELECT user_id, event_id, bad,
       CAST(sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode
FROM (SELECT *, CAST(coalesce(bad <> lag(bad) {_RAW_W}, true) AS INTEGER) AS chg
      FROM (SELECT user_id, ts, event_id, CAST(value > 60 AS INTEGER) AS bad FROM events
            WHERE value IS NOT NULL))""")
def q_islands_raw(spark, sf):
    """W8 on raw event rows per series (value > 60), in blocks."""
    out = B.islands(_raw_events(spark, sf), ts="ts", col="value", threshold=60.0, series_cols=US,
                    tiebreak=["event_id"])
    return out.select("user_id", "event_id", "bad", "episode")


@query("episodes_raw", f"""
SELECT user_id, CAST(episode AS BIGINT) AS episode, strftime(arg_min(ts, (ts, event_id)), '%Y-%m-%d') AS debut,
       strftime(arg_max(ts, (ts, event_id)), '%Y-%m-%d') AS fin, count(*) AS duree,
       max(value) AS aqi_max, avg(value) AS aqi_moy
FROM (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
      FROM (SELECT *, CAST(coalesce(bad <> lag(bad) {_RAW_W}, true) AS INTEGER) AS chg
            FROM (SELECT user_id, ts, event_id, value, CAST(value > 60 AS INTEGER) AS bad FROM events
                  WHERE value IS NOT NULL)))
WHERE bad = 1 GROUP BY user_id, episode HAVING count(*) >= 6""")
def q_episodes_raw(spark, sf):
    """A26 on raw event rows per series (value > 60 for at least 6 rows), run ids
    from the blocked islands (no series held by one task)."""
    ev = _raw_events(spark, sf).select("user_id", "ts", "event_id", "value")
    return W.episodes(ev, ts="ts", col="value", series_cols=US, block_rows=B.BLOCK_ROWS,
                      tiebreak=["event_id"])
