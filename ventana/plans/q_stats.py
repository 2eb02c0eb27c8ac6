"""Describe, data quality, correlations, distributions, joins (phase 3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import alert_class, level4, range_text, rounded, with_unit
from ..operators import columns as C
from ..operators import joins as J
from ..operators import resample as R
from ..operators import stats as S
from .registry import query
from .sqltext import corr, rnd, win
from .standins import H_SQL, POLLUTANTS, U_SQL, station_hourly, table, users_hourly, with_ctes


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("describe", with_ctes(_union([f"""
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM H""" for c in POLLUTANTS]), H=H_SQL))
def q_describe(spark, sf):
    """Describe of the station columns, one row per column."""
    return S.describe(station_hourly(spark, sf), POLLUTANTS)


_DCOLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("distinct_counts", _union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM lineitem"""
    for c in _DCOLS]))
def q_distinct_counts(spark, sf):
    """Exact distinct counts per column of lineitem, with the row count."""
    return S.distinct_counts(table(spark, sf, "lineitem"), _DCOLS)


@query("missing_report", with_ctes(_union([f"""
SELECT '{c}' AS "column", CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing,
       count_if({c} IS NULL) * 100.0 / count(*) AS pct_missing FROM U""" for c in ["user_id", "date"] + POLLUTANTS]),
    U=U_SQL))
def q_missing_report(spark, sf):
    """Missing values per column of the per-series hourly table."""
    return S.missing_report(users_hourly(spark, sf))


@query("dq_report", with_ctes(_union([f"""
SELECT '{c}' AS "column", count_if({c} IS NULL) / count(*) AS missing_share, count(*) AS total_rows,
       (SELECT strftime(max(date), '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM H) AS last_update,
       0 AS anomalies_detected,
       (SELECT CAST(count_if(pm2_5 < 0 OR pm2_5 > 500) AS BIGINT) FROM H) AS pm25_range_violation
FROM H""" for c in POLLUTANTS]), H=H_SQL).replace("0 AS anomalies_detected", "CAST(0 AS INTEGER) AS anomalies_detected"))
def q_dq_report(spark, sf):
    """Data-quality report, null-share map exploded to one row per column."""
    rep = S.dq_report(station_hourly(spark, sf), ts="date", cols=POLLUTANTS)
    return rep.select(F.explode("missing_values_pct").alias("column", "missing_share"),
                      "total_rows", "last_update", "anomalies_detected", "pm25_range_violation")


@query("linreg", """
SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope,
       regr_intercept(l_extendedprice, l_quantity) AS intercept,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
       min(CASE WHEN l_extendedprice IS NOT NULL THEN l_quantity END) AS x_min,
       max(CASE WHEN l_extendedprice IS NOT NULL THEN l_quantity END) AS x_max
FROM lineitem GROUP BY 1""")
def q_linreg(spark, sf):
    """Least-squares line of price on quantity per return flag (all rows)."""
    return S.linreg(table(spark, sf, "lineitem"), x="l_quantity", y="l_extendedprice",
                    series_cols=["l_returnflag"])


@query("fit_line", """
SELECT l_returnflag, CAST(i AS INTEGER) AS i, x_min + i * (x_max - x_min) / 49 AS x,
       intercept + slope * (x_min + i * (x_max - x_min) / 49) AS y_fit
FROM (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope,
             regr_intercept(l_extendedprice, l_quantity) AS intercept,
             min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem GROUP BY 1),
     range(0, 50) AS t(i)""")
def q_fit_line(spark, sf):
    """P25: fitted line over 50 even x values per return flag."""
    line = S.linreg(table(spark, sf, "lineitem"), x="l_quantity", y="l_extendedprice",
                    series_cols=["l_returnflag"])
    return S.fit_line(line, 50, series_cols=["l_returnflag"])


def _corr_sql(src, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {corr(a, b)} AS corr FROM {src}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {corr(a, b)} AS corr FROM {src}")
    return _union(parts)


@query("corr_pairwise", with_ctes(_corr_sql("H", POLLUTANTS), H=H_SQL))
def q_corr_pairwise(spark, sf):
    """Pairwise-complete correlation matrix, long form."""
    return S.corr_matrix(station_hourly(spark, sf), POLLUTANTS)


@query("corr_listwise", with_ctes(_corr_sql("HC", POLLUTANTS), H=H_SQL,
                                  HC="SELECT * FROM H WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in POLLUTANTS)))
def q_corr_listwise(spark, sf):
    """Correlation after dropping rows with any null."""
    return S.corr_matrix(station_hourly(spark, sf), POLLUTANTS, listwise=True)


@query("corr_target", with_ctes(_union([
    f"""SELECT '{c}' AS "column", {corr(c, 'pm2_5')} AS corr FROM H""" for c in POLLUTANTS]), H=H_SQL))
def q_corr_target(spark, sf):
    """Correlation of every column with PM2.5, strongest first."""
    return S.corr_target(station_hourly(spark, sf), "pm2_5", POLLUTANTS)


@query("histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 40.0 AS w
           FROM lineitem)
SELECT CAST(bin AS INTEGER) AS bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, count(*) AS n
FROM (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INTEGER), 39) AS bin, lo, w
      FROM lineitem, b WHERE l_extendedprice IS NOT NULL)
GROUP BY bin, lo, w""")
def q_histogram(spark, sf):
    """40 equal-width bins of the extended price."""
    return S.histogram(table(spark, sf, "lineitem"), "l_extendedprice", bins=40)


@query("box_stats", with_ctes("""
SELECT q.hour, q1, median, q3, mean, sd, n, lower_whisker, upper_whisker, n_outliers
FROM q JOIN (
  SELECT hour, min(CASE WHEN inside THEN x END) AS lower_whisker,
         max(CASE WHEN inside THEN x END) AS upper_whisker,
         CAST(count_if(NOT inside) AS BIGINT) AS n_outliers
  FROM (SELECT h.hour, h.x, h.x >= q.q1 - 1.5 * (q.q3 - q.q1) AND h.x <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
        FROM hx h JOIN q ON h.hour = q.hour) GROUP BY hour) w ON q.hour = w.hour""",
    H=H_SQL,
    hx="SELECT CAST(hour(date) AS INTEGER) AS hour, pm2_5 AS x FROM H WHERE pm2_5 IS NOT NULL",
    q="""SELECT hour, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                quantile_cont(x, 0.75) AS q3, avg(x) AS mean, stddev_pop(x) AS sd, count(x) AS n
         FROM hx GROUP BY hour"""))
def q_box_stats(spark, sf):
    """Box statistics of PM2.5 by hour of day."""
    h = station_hourly(spark, sf).withColumn("hour", F.hour("date"))
    return S.box_stats(h, "pm2_5", ["hour"])


@query("density2d", with_ctes("""
SELECT lv AS level, CAST(bx AS INTEGER) AS bx, CAST("by" AS INTEGER) AS "by", count(*) AS n FROM (
  SELECT CASE WHEN pm2_5 <= 12.0 THEN 'Bon' WHEN pm2_5 <= 35.5 THEN 'Moyen' ELSE 'Mauvais' END AS lv,
         least(coalesce(CAST(floor((pm10 - xlo) / nullif(xw, 0)) AS INTEGER), 0), 19) AS bx,
         least(coalesce(CAST(floor((pm2_5 - ylo) / nullif(yw, 0)) AS INTEGER), 0), 19) AS "by"
  FROM H, (SELECT min(pm10) AS xlo, (max(pm10) - min(pm10)) / 20.0 AS xw,
                  min(pm2_5) AS ylo, (max(pm2_5) - min(pm2_5)) / 20.0 AS yw FROM H)
  WHERE pm10 IS NOT NULL AND pm2_5 IS NOT NULL)
GROUP BY 1, 2, 3""", H=H_SQL))
def q_density2d(spark, sf):
    """20 x 20 bin counts of (pm10, pm2_5) by PM2.5 level."""
    return S.density2d(station_hourly(spark, sf), "pm10", "pm2_5", bins=20)


@query("wind_rose", """
WITH c AS (
  SELECT CAST(floor((((l_extendedprice % 360) + 360) % 360) / 22.5) AS INTEGER) % 16 AS sector,
         CASE WHEN l_quantity >= 0 AND l_quantity < 5 THEN 0 WHEN l_quantity >= 5 AND l_quantity < 10 THEN 1
              WHEN l_quantity >= 10 AND l_quantity < 15 THEN 2 WHEN l_quantity >= 15 AND l_quantity < 20 THEN 3
              WHEN l_quantity >= 20 AND l_quantity < 50 THEN 4 END AS speed_bin
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
g AS (SELECT CAST(i // 5 AS INTEGER) AS sector, CAST(i % 5 AS INTEGER) AS speed_bin FROM range(0, 80) t(i))
SELECT g.sector, CAST(floor(g.sector * 22.5) AS INTEGER) AS sector_deg, g.speed_bin,
       ['0-5', '5-10', '10-15', '15-20', '>20'][g.speed_bin + 1] AS speed_label, coalesce(n, 0) AS n
FROM g LEFT JOIN (SELECT sector, speed_bin, count(*) AS n FROM c WHERE speed_bin IS NOT NULL GROUP BY 1, 2) k
  ON g.sector = k.sector AND g.speed_bin = k.speed_bin""")
def q_wind_rose(spark, sf):
    """16 sectors x 5 speed bins (price as angle, quantity as speed)."""
    return S.wind_rose(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


@query("sample_n", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY md5('42-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber
LIMIT 2000""")
def q_sample_n(spark, sf):
    """L4: repeatable sample of min(2000, n) rows by hashed key (a sampling operator)."""
    from ..operators.sampling import hashed_sample
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice")
    return hashed_sample(li, ["l_orderkey", "l_linenumber"], n=2000, seed=42)


@query("autocorr", with_ctes(_union([f"""
SELECT CAST({k} AS INTEGER) AS lag, {corr('x', f'l{k}')} AS acf FROM lg""" for k in range(1, 25)]),
    H=H_SQL,
    lg="SELECT pm2_5 AS x, " + ", ".join(f"lag(pm2_5, {k}) {win([], 'date')} AS l{k}" for k in range(1, 25)) + " FROM H"))
def q_autocorr(spark, sf):
    """Autocorrelation of PM2.5 at lags 1..24."""
    return S.autocorr(station_hourly(spark, sf), ts="date", value_col="pm2_5", max_lag=24)


_UDAY = "SELECT user_id, CAST(date AS DATE) AS day, " + ", ".join(f"avg({c}) AS {c}" for c in POLLUTANTS) + " FROM U GROUP BY 1, 2"
_UCAL = """SELECT c.user_id, c.day, d.* EXCLUDE (user_id, day) FROM (
  SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)) c
LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day"""


@query("drop_sparse", with_ctes(_union([f"""
SELECT '{c}' AS "column", count_if({c} IS NULL) / count(*) AS null_share,
       count_if({c} IS NULL) / count(*) <= 0.5 AS kept FROM ud""" for c in POLLUTANTS]),
    U=U_SQL, d=_UDAY, ud=_UCAL))
def q_drop_sparse(spark, sf):
    """Null shares of the daily per-series table and the keep/drop decision."""
    daily = R.daily_resample(users_hourly(spark, sf), ts="date", value_cols=POLLUTANTS,
                             series_cols=["user_id"])
    kept = S.drop_sparse(daily, POLLUTANTS, max_null_share=0.5).columns
    shares = S.missing_report(daily, POLLUTANTS)
    return shares.select("column", (F.col("pct_missing") / 100).alias("null_share"),
                         F.col("column").isin([c for c in POLLUTANTS if c in kept]).alias("kept"))


@query("range_violations", with_ctes(_union([f"""
SELECT '{c}' AS "column", CAST(count_if({c} < 0 OR {c} > 500) AS BIGINT) AS n_violations FROM U"""
    for c in POLLUTANTS]), U=U_SQL))
def q_range_violations(spark, sf):
    """Values outside [0, 500] per column."""
    return S.range_violations(users_hourly(spark, sf), POLLUTANTS)


# --- joins -------------------------------------------------------------------

_AIR = """SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 100 AS pm2_5,
       avg(l_quantity) AS pm10 FROM lineitem GROUP BY 1"""
_METEO = """SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS temperature_2m,
       count(*) AS relative_humidity_2m FROM orders GROUP BY 1"""


def _air(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        (F.avg("l_discount") * 100).alias("pm2_5"), F.avg("l_quantity").alias("pm10"))


def _meteo(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 10000).alias("temperature_2m"),
        F.count(F.lit(1)).alias("relative_humidity_2m"))


@query("merge_sources", with_ctes("""
SELECT strftime(a.date, '%Y-%m-%d') AS date, a.pm2_5, a.pm10, m.temperature_2m, m.relative_humidity_2m
FROM air a JOIN meteo m ON a.date = m.date
WHERE a.pm10 IS NOT NULL AND a.pm2_5 IS NOT NULL AND m.temperature_2m IS NOT NULL""",
    air=_AIR, meteo=_METEO))
def q_merge_sources(spark, sf):
    """Inner join of two daily grids on the date, then drop critical nulls."""
    return J.merge_sources(_air(spark, sf), _meteo(spark, sf), on=["date"])


@query("flagged_days", with_ctes("""
SELECT d.date_str, d.pm2_5, d.pm10, f.anomaly FROM
  (SELECT strftime(date, '%Y-%m-%d') AS date_str, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10 FROM H GROUP BY 1) d
LEFT JOIN (SELECT strftime(date, '%Y-%m-%d') AS date_str,
                  max(CAST(coalesce(pm2_5 > (SELECT quantile_cont(pm2_5, 0.95) FROM H), false) AS INTEGER)) AS anomaly
           FROM H GROUP BY 1) f ON d.date_str = f.date_str
WHERE f.anomaly = 1""", H=H_SQL))
def q_flagged_days(spark, sf):
    """J2 + A25: daily means of the days holding a flagged hour (flag: above P95).

    Both sides come from the same hourly rows, so the join of the daily means
    with the daily flag is fused into one aggregation (equality with the join
    form is tested)."""
    h = station_hourly(spark, sf)
    p95 = h.select(F.percentile("pm2_5", 0.95)).scalar()
    h = h.withColumn("anomaly", F.coalesce(F.col("pm2_5") > p95, F.lit(False)).cast("int"))
    return J.flagged_days_fused(h, ts="date", value_cols=["pm2_5", "pm10"])


def _status_sql(src):
    rows = []
    for i, (m, lim) in enumerate(V.GUIDELINE_LIMITS.items()):
        if m not in POLLUTANTS:
            continue
        rows.append(f"""
SELECT '{m}' AS measure, CAST({i} AS INTEGER) AS measure_order, v AS value, CAST({lim} AS DOUBLE) AS "limit",
       v / nullif({lim}, 0) AS ratio, v - {lim} AS delta,
       CASE WHEN v / {lim} > 1 THEN 'danger' WHEN v / {lim} > 0.75 THEN 'amber' ELSE 'teal' END AS gauge_class,
       CASE WHEN v <= {lim} THEN 'OK' ELSE 'Dépassé' END AS status,
       CASE WHEN v IS NOT NULL THEN printf('%.2f μg/m³', v) END AS value_text,
       '{int(lim)} μg/m³' AS limit_text
FROM (SELECT {rnd(f'avg({m})', 6)} AS v FROM {src})""")
    n = len(V.GUIDELINE_LIMITS)
    lim = V.INDEX_LIMIT
    rows.append(f"""
SELECT 'european_aqi' AS measure, CAST({n} AS INTEGER) AS measure_order, v AS value, CAST({lim} AS DOUBLE) AS "limit",
       v / nullif({lim}, 0) AS ratio, v - {lim} AS delta,
       CASE WHEN v / {lim} > 1 THEN 'danger' WHEN v / {lim} > 0.75 THEN 'amber' ELSE 'teal' END AS gauge_class,
       CASE WHEN v <= {lim} THEN 'OK' ELSE '{V.STATUS_HIGH}' END AS status,
       printf('%.2f', v) AS value_text, '{int(lim)}' AS limit_text
FROM (SELECT {rnd('avg(european_aqi)', 6)} AS v FROM {src})""")
    return _union(rows)


@query("threshold_status", with_ctes(_status_sql("H"), H=H_SQL))
def q_threshold_status(spark, sf):
    """Station means against guideline limits, plus the mean index against
    its limit: ratio, delta, class, status, texts.

    The means are rounded to 6 digits before they are compared and formatted: the printed
    digit of a mean on a .xx5 tie would otherwise depend on each engine's summation order."""
    h = station_hourly(spark, sf)
    cols = [m for m in V.GUIDELINE_LIMITS if m in h.columns] + ["european_aqi"]
    means = h.agg(*[rounded(F.avg(m), 6).alias(m) for m in cols])
    return J.threshold_status(means, index_col="european_aqi")


@query("gauge", with_ctes(_union([f"""
SELECT user_id, '{m}' AS measure, CAST({i} AS INTEGER) AS measure_order, {m} AS value, CAST({lim} AS DOUBLE) AS "limit",
       {m} / nullif({lim}, 0) AS ratio, {m} - {lim} AS delta,
       CASE WHEN {m} / {lim} > 1 THEN 'danger' WHEN {m} / {lim} > 0.75 THEN 'amber' ELSE 'teal' END AS gauge_class,
       CASE WHEN {m} <= {lim} THEN 'OK' ELSE 'Dépassé' END AS status,
       CASE WHEN {m} IS NOT NULL THEN printf('%.2f μg/m³', {m}) END AS value_text,
       '{int(lim)} μg/m³' AS limit_text
FROM um""" for i, (m, lim) in enumerate(V.GUIDELINE_LIMITS.items()) if m in POLLUTANTS]),
    U=U_SQL, um="SELECT user_id, " + ", ".join(f"{rnd(f'avg({c})', 6)} AS {c}" for c in ("pm2_5", "pm10", "ozone")) + " FROM U GROUP BY 1"))
def q_gauge(spark, sf):
    """J5 per series: the gauge table of every series (unpivot + lookup join), of means
    rounded to 6 digits (see ``threshold_status``)."""
    u = users_hourly(spark, sf)
    means = u.groupBy("user_id").agg(*[rounded(F.avg(m), 6).alias(m) for m in ["pm2_5", "pm10", "ozone"]])
    return J.threshold_status(means, series_cols=["user_id"])


@query("alert_text", with_ctes(f"""
SELECT date_str, CASE WHEN v IS NOT NULL THEN printf('%.2f μg/m³', v) END AS value_text, lab AS aqi_label,
       CASE WHEN coalesce(contains(lab, 'Mauvais'), false) THEN 'alert-bad'
            WHEN coalesce(contains(lab, 'Bon'), false) THEN 'alert-good' END AS alert,
       (SELECT min(strftime(date, '%Y-%m-%d')) || ' → ' || max(strftime(date, '%Y-%m-%d')) FROM H) AS period
FROM (SELECT date_str, v, CASE WHEN v <= 12.0 THEN 'Bon' WHEN v <= 35.0 THEN 'Modéré'
                  WHEN v <= 55.0 THEN 'Mauvais' ELSE 'Très Mauvais' END AS lab
      FROM (SELECT strftime(date, '%Y-%m-%d') AS date_str, {rnd('avg(pm2_5)', 3)} AS v FROM H GROUP BY 1))""", H=H_SQL))
def q_alert_text(spark, sf):
    """KPI text, label, alert class per day (means to 3 digits, as published), and the
    period text, taken from the same daily rows."""
    d = R.daily_mean(station_hourly(spark, sf), ts="date", value_cols=["pm2_5"], digits=V.MEAN_DIGITS)
    all_days = Window.partitionBy()
    return d.select("date_str", with_unit("pm2_5").alias("value_text"),
                    level4("pm2_5").alias("aqi_label"), alert_class(level4("pm2_5")).alias("alert"),
                    range_text(F.min("date_str").over(all_days), F.max("date_str").over(all_days))
                    .alias("period"))


@query("short_names", with_ctes(f"""
SELECT strftime(date, '%Y-%m-%d') AS date_str, avg(pm2_5) AS "PM2.5", avg(pm10) AS "PM10",
       avg(carbon_monoxide) AS "CO", avg(ozone) AS "O3", avg(european_aqi) AS "AQI",
       CAST({V.STATION_LAT} AS DOUBLE) AS lat, CAST({V.STATION_LON} AS DOUBLE) AS lon
FROM H GROUP BY 1""", H=H_SQL))
def q_short_names(spark, sf):
    """P24 + P20: daily means under short labels, station coordinates added."""
    d = R.daily_mean(station_hourly(spark, sf), ts="date", value_cols=POLLUTANTS)
    return C.with_coordinates(C.short_names(d))


@query("box_stats_overall", with_ctes("""
SELECT q1, median, q3, mean, sd, n,
       min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS lower_whisker,
       max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS upper_whisker,
       CAST(count_if(NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM lx, (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                 quantile_cont(x, 0.75) AS q3, avg(x) AS mean, stddev_pop(x) AS sd, count(x) AS n FROM lx)
GROUP BY q1, median, q3, mean, sd, n""",
    lx="SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL"))
def q_box_stats_overall(spark, sf):
    """A21 over all rows (no group): quartiles, whiskers and outliers of the price."""
    return S.box_stats(table(spark, sf, "lineitem"), "l_extendedprice")


def _corr_series_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
                parts.append(f"SELECT user_id, '{x}' AS col_a, '{y}' AS col_b, {corr(a, b)} AS corr "
                             f"FROM U GROUP BY user_id")
    return _union(parts)


@query("corr_by_series", with_ctes(_corr_series_sql(["pm2_5", "ozone", "european_aqi"]), U=U_SQL))
def q_corr_by_series(spark, sf):
    """A17 per series: pairwise-complete correlation matrix of every station in one
    aggregation (constant or too-short pairs give NULL)."""
    return S.corr_matrix(users_hourly(spark, sf), ["pm2_5", "ozone", "european_aqi"],
                         series_cols=["user_id"])
