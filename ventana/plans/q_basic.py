"""Scalar functions, labels, daily resampling, profiles, shares (phase 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import (calendar_parts, level3, level4, level4_advice, level_max,
                               local_time, rain_class, safe_ratio, season)
from ..operators import profiles as P
from ..operators import resample as R
from .registry import query
from .sqltext import day_txt, rnd, ts_txt
from .standins import H_SQL, O_SQL, POLLUTANTS, U_SQL, orders_daily, station_hourly, table, \
    users_hourly, with_ctes

PCOLS = ", ".join(POLLUTANTS)


def _level3_sql(x: str) -> str:
    b, lab = V.LEVEL3_BOUNDS, V.LEVEL3_LABELS
    return f"CASE WHEN {x} <= {b[0]} THEN '{lab[0]}' WHEN {x} <= {b[1]} THEN '{lab[1]}' ELSE '{lab[2]}' END"


@query("calendar_parts", f"""
SELECT event_id, {ts_txt('ts')} AS ts, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
       strftime(ts, '%Y-%m-%d') AS date_str, strftime(ts, '%b %Y') AS month_str
FROM events""")
def q_calendar_parts(spark, sf):
    """P1 on every event row."""
    return calendar_parts(table(spark, sf, "events").select("event_id", "ts"), ts="ts")


@query("local_time", f"""
SELECT event_id, {ts_txt("ts + INTERVAL 1 HOUR")} AS local_ts FROM events""")
def q_local_time(spark, sf):
    """Station wall clock (UTC+1)."""
    return table(spark, sf, "events").select("event_id", local_time("ts").alias("local_ts"))


@query("safe_ratio", with_ctes(f"""
SELECT {ts_txt('date')} AS date, round(pm2_5 / nullif(pm10, 0), 3) AS pm_ratio FROM H""", H=H_SQL))
def q_safe_ratio(spark, sf):
    """PM2.5/PM10 with zero divisors as NULL, 3 digits."""
    return station_hourly(spark, sf).select("date", safe_ratio("pm2_5", "pm10", 3).alias("pm_ratio"))


@query("season", f"""
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN '{V.SEASON_DRY}' ELSE '{V.SEASON_WET}' END AS saison
FROM orders""")
def q_season(spark, sf):
    """P4 on order dates (all months present)."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.month("o_orderdate").alias("month"),
                    season(F.month("o_orderdate")).alias("saison"))


@query("level3", with_ctes(f"""
SELECT {ts_txt('date')} AS date, pm2_5, {_level3_sql('pm2_5')} AS aqi_level FROM H""", H=H_SQL))
def q_level3(spark, sf):
    """P5: three-level label, NULL falls to the worst level."""
    return station_hourly(spark, sf).select("date", "pm2_5", level3("pm2_5").alias("aqi_level"))


def _level4_sql(x: str, what) -> str:
    b = V.LEVEL4_BOUNDS
    esc = [w.replace("'", "''") for w in what]
    return (f"CASE WHEN {x} <= {b[0]} THEN '{esc[0]}' WHEN {x} <= {b[1]} THEN '{esc[1]}' "
            f"WHEN {x} <= {b[2]} THEN '{esc[2]}' ELSE '{esc[3]}' END")


@query("level4", with_ctes(f"""
SELECT {ts_txt('date')} AS date, {_level4_sql('pm2_5', V.LEVEL4_LABELS)} AS aqi_label,
       {_level4_sql('pm2_5', V.LEVEL4_ADVICE)} AS conseil FROM H""", H=H_SQL))
def q_level4(spark, sf):
    """Four-level label and advice (35, not 35.5)."""
    return station_hourly(spark, sf).select("date", level4("pm2_5").alias("aqi_label"),
                                            level4_advice("pm2_5").alias("conseil"))


_MX = "CASE WHEN pm10 IS NULL THEN NULL WHEN pm2_5 > pm10 THEN pm2_5 ELSE pm10 END"


@query("level_max", with_ctes(f"""
SELECT {ts_txt('date')} AS date, {_MX} AS pm_max,
       CASE WHEN ({_MX}) <= 12.0 THEN 'Bon' WHEN ({_MX}) <= 35.5 THEN 'Modéré' ELSE 'Mauvaise' END AS AQI
FROM H""", H=H_SQL))
def q_level_max(spark, sf):
    """Label of max(pm10, pm2_5) with Python's NaN rule."""
    from ..functions.exprs import larger_of
    return station_hourly(spark, sf).select(
        "date", larger_of("pm10", "pm2_5").alias("pm_max"), level_max("pm10", "pm2_5").alias("AQI"))


@query("rain_class", """
SELECT l_orderkey, l_linenumber, l_tax * 50 AS rain,
       CASE WHEN l_tax * 50 < 1 THEN 'blue' WHEN l_tax * 50 < 3 THEN 'teal' ELSE 'coral' END AS rain_class
FROM lineitem WHERE l_tax * 50 > 0""")
def q_rain_class(spark, sf):
    """Positive amounts only, then intensity class (tax x 50 plays rain)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             (F.col("l_tax") * 50).alias("rain"))
    return li.filter(F.col("rain") > 0).withColumn("rain_class", rain_class("rain"))


@query("drop_nulls", with_ctes(f"""
SELECT {ts_txt('date')} AS date, {PCOLS} FROM H WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL""",
                               H=H_SQL))
def q_drop_nulls(spark, sf):
    """Drop rows with a null in a column list."""
    return station_hourly(spark, sf).dropna(subset=["pm2_5", "pm10"])


@query("daily_mean", with_ctes(f"""
SELECT *, {_level3_sql('pm2_5')} AS aqi_level
FROM (SELECT strftime(date, '%Y-%m-%d') AS date_str, {', '.join(f'{rnd(f"avg({c})", 3)} AS {c}' for c in POLLUTANTS)}
      FROM H GROUP BY 1)""", H=H_SQL))
def q_daily_mean(spark, sf):
    """A1: daily mean by day text (no calendar), rounded to 3 digits, then the level of the
    rounded PM2.5, as published."""
    d = R.daily_mean(station_hourly(spark, sf), ts="date", value_cols=POLLUTANTS, digits=V.MEAN_DIGITS)
    return d.withColumn("aqi_level", level3("pm2_5"))


_UD = """SELECT user_id, CAST(date AS DATE) AS day, {aggs} FROM U GROUP BY 1, 2"""
_CAL = """SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)"""


@query("daily_resample", with_ctes(f"""
SELECT c.user_id, {day_txt('c.day')} AS day, {', '.join(f'd.{c}' for c in POLLUTANTS)}
FROM cal c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day""",
    U=U_SQL, d=_UD.format(aggs=", ".join(f"avg({c}) AS {c}" for c in POLLUTANTS)), cal=_CAL))
def q_daily_resample(spark, sf):
    """A2: per-series daily means on a full calendar (empty days NULL)."""
    return R.daily_resample(users_hourly(spark, sf), ts="date", value_cols=POLLUTANTS,
                            series_cols=["user_id"])


_MIXED = [("pm_mean", "mean", "pm2_5"), ("pm_min", "min", "pm2_5"), ("pm_max", "max", "pm2_5"),
          ("ozone_sum", "sum", "ozone"), ("aqi_median", "median", "european_aqi")]


@query("daily_mixed", with_ctes("""
SELECT c.user_id, strftime(c.day, '%Y-%m-%d') AS day, d.pm_mean, d.pm_min, d.pm_max,
       coalesce(d.ozone_sum, 0) AS ozone_sum, d.aqi_median
FROM cal c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day""",
    U=U_SQL, d=_UD.format(aggs="avg(pm2_5) AS pm_mean, min(pm2_5) AS pm_min, max(pm2_5) AS pm_max, "
                               "sum(ozone) AS ozone_sum, median(european_aqi) AS aqi_median"),
    cal=_CAL))
def q_daily_mixed(spark, sf):
    """A3: daily mean/min/max/sum/median, renamed; empty-day sums are 0."""
    return R.daily_resample(users_hourly(spark, sf), ts="date", series_cols=["user_id"],
                            aggs=_MIXED)


@query("hour_profile", with_ctes(f"""
SELECT CAST(hour(date) AS INTEGER) AS hour, {', '.join(f'avg({c}) AS {c}' for c in POLLUTANTS)}
FROM H GROUP BY 1""", H=H_SQL))
def q_hour_profile(spark, sf):
    """A4: mean per hour of day."""
    return P.hour_profile(station_hourly(spark, sf), value_cols=POLLUTANTS)


_MONTH_CASE = "CASE " + " ".join(f"WHEN m = {k} THEN '{v}'" for k, v in V.MONTH_LABELS.items()) + " END"


@query("month_profile", with_ctes(f"""
SELECT CAST(m AS INTEGER) AS month, avg(value) AS value, {_MONTH_CASE} AS month_label
FROM (SELECT month(date) AS m, value FROM O) GROUP BY m""", O=O_SQL))
def q_month_profile(spark, sf):
    """A5: mean per calendar month (years merged) + month label."""
    return P.month_profile(orders_daily(spark, sf), value_cols=["value"])


_SHARES_SQL = with_ctes(f"""
SELECT l.aqi_level, CAST(l.level_order AS INTEGER) AS level_order, coalesce(c.n, 0) AS n,
       coalesce(c.n, 0) * 100.0 / (SELECT count(*) FROM H) AS share_pct
FROM (VALUES ('Bon', 0), ('Moyen', 1), ('Mauvais', 2)) AS l(aqi_level, level_order)
LEFT JOIN (SELECT {_level3_sql('pm2_5')} AS aqi_level, count(*) AS n FROM H GROUP BY 1) c
  ON l.aqi_level = c.aqi_level""", H=H_SQL)


@query("level_shares", _SHARES_SQL)
def q_level_shares(spark, sf):
    """Count and share of rows per level, fixed order, absent levels 0."""
    h = station_hourly(spark, sf).withColumn("aqi_level", level3("pm2_5"))
    return P.level_shares(h)


@query("level_hours", with_ctes("""
SELECT CAST(count_if(pm2_5 > 35.5) AS BIGINT) AS hours_bad,
       CAST(count_if(pm2_5 > 12 AND pm2_5 <= 35.5) AS BIGINT) AS hours_moderate,
       CAST(count_if(pm2_5 <= 12) AS BIGINT) AS hours_good FROM H""", H=H_SQL))
def q_level_hours(spark, sf):
    """Hours per PM2.5 band."""
    return P.level_hours(station_hourly(spark, sf))


@query("quantiles", with_ctes("""
SELECT user_id, quantile_cont(pm2_5, 0.95) AS pm2_5_q95, median(pm2_5) AS pm2_5_median,
       quantile_cont(european_aqi, 0.95) AS european_aqi_q95, median(european_aqi) AS european_aqi_median
FROM U GROUP BY 1""", U=U_SQL))
def q_quantiles(spark, sf):
    """Exact P95 and median per series (linear interpolation)."""
    return P.quantiles(users_hourly(spark, sf), value_cols=["pm2_5", "european_aqi"],
                       series_cols=["user_id"])


@query("kpi_row", with_ctes(f"""
SELECT *, CASE WHEN index_mean <= 50 THEN 'Bon' WHEN index_mean <= 100 THEN 'Modéré'
               ELSE 'Mauvais' END AS index_label
FROM (SELECT {rnd('avg(pm2_5)', 2)} AS pm2_5_mean, {rnd('avg(pm10)', 2)} AS pm10_mean,
             {rnd('avg(ozone)', 2)} AS ozone_mean, {rnd('quantile_cont(pm2_5, 0.95)', 2)} AS pm2_5_p95,
             {rnd('avg(pm2_5 / nullif(pm10, 0))', 2)} AS pm_ratio_mean,
             {rnd('avg(european_aqi)', 2)} AS index_mean, count(*) AS n_rows FROM H)""", H=H_SQL))
def q_kpi_row(spark, sf):
    """A10 + P8: KPI row of the station, to 2 digits; the index is labelled after rounding."""
    return P.kpi_row(station_hourly(spark, sf))


@query("dominant_level", with_ctes(f"""
SELECT user_id, bad_pct, moderate_pct, good_pct,
       CASE WHEN bad_pct > 50 THEN 'Mauvais' WHEN moderate_pct > 50 THEN 'Modéré' ELSE 'Bon' END AS dominant
FROM (SELECT user_id,
             {rnd("count_if(lv = 'Mauvais') * 100.0 / count(*)", 2)} AS bad_pct,
             {rnd("count_if(lv = 'Moyen') * 100.0 / count(*)", 2)} AS moderate_pct,
             {rnd("count_if(lv = 'Bon') * 100.0 / count(*)", 2)} AS good_pct
      FROM (SELECT user_id, {_level3_sql('pm2_5')} AS lv FROM U) GROUP BY 1)""", U=U_SQL))
def q_dominant_level(spark, sf):
    """Dominant level per series, from shares rounded to 2 digits."""
    return P.dominant_level(users_hourly(spark, sf), series_cols=["user_id"])


@query("level_shares_series", with_ctes(f"""
SELECT g.user_id, g.aqi_level, CAST(g.level_order AS INTEGER) AS level_order, coalesce(c.n, 0) AS n,
       coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.user_id) AS share_pct
FROM (SELECT user_id, unnest(['Bon', 'Moyen', 'Mauvais']) AS aqi_level, unnest([0, 1, 2]) AS level_order
      FROM (SELECT DISTINCT user_id FROM U)) g
LEFT JOIN (SELECT user_id, {_level3_sql('pm2_5')} AS aqi_level, count(*) AS n FROM U GROUP BY 1, 2) c
  ON g.user_id = c.user_id AND g.aqi_level = c.aqi_level""", U=U_SQL))
def q_level_shares_series(spark, sf):
    """A7 per series: every level of every station with its count and share."""
    u = users_hourly(spark, sf).withColumn("aqi_level", level3("pm2_5"))
    return P.level_shares(u, series_cols=["user_id"])
