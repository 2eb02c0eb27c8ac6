"""Results in their published rounding, the monitoring report, the source fallback across formats,
and queries of operators that other queries only contain (P13, P16, S7, S8, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import flag_to_int, level3
from ..operators import features as FT
from ..operators import joins as J
from ..operators import learn as L
from ..operators import profiles as P
from ..operators import resample as R
from ..operators import stats as S
from ..operators import windows as W
from ..session import scratch_path
from ..sources import files, store
from .q_basic import _MONTH_CASE, _SHARES_SQL
from .q_io import _BATCH, _FIRST
from .q_learn import _BT_INPUTS
from .q_stats import _corr_sql
from .q_windows import _HCAL, _HD, _ISL
from .registry import query
from .sqltext import interp_select, rnd, rolling_mean, ts_txt, win
from .standins import H_SQL, O_SQL, POLLUTANTS, U_SQL, orders_daily, station_hourly, table, users_hourly, with_ctes


@query("hour_profile_published", with_ctes(f"""
SELECT CAST(hour(date) AS INTEGER) AS hour, {', '.join(f'{rnd(f"avg({c})", 3)} AS {c}' for c in POLLUTANTS)}
FROM H GROUP BY 1""", H=H_SQL))
def q_hour_profile(spark, sf):
    """A4 to 3 digits."""
    return P.hour_profile(station_hourly(spark, sf), value_cols=POLLUTANTS, digits=V.MEAN_DIGITS)


@query("month_profile_published", with_ctes(f"""
SELECT CAST(m AS INTEGER) AS month, {rnd('avg(value)', 2)} AS value, {_MONTH_CASE} AS month_label
FROM (SELECT month(date) AS m, value FROM O) GROUP BY m""", O=O_SQL))
def q_month_profile(spark, sf):
    """A5 to 2 digits."""
    return P.month_profile(orders_daily(spark, sf), value_cols=["value"], digits=V.MONTH_DIGITS)


@query("level_shares_published", f"SELECT * REPLACE ({rnd('share_pct', 2)} AS share_pct) FROM ({_SHARES_SQL})")
def q_level_shares(spark, sf):
    """A7 to 2 digits."""
    h = station_hourly(spark, sf).withColumn("aqi_level", level3("pm2_5"))
    return P.level_shares(h, digits=V.KPI_DIGITS)


@query("corr_published", with_ctes(f"SELECT col_a, col_b, {rnd('corr', 3)} AS corr FROM ({_corr_sql('H', POLLUTANTS)})",
                                   H=H_SQL))
def q_corr(spark, sf):
    """A17 to 3 digits."""
    return S.corr_matrix(station_hourly(spark, sf), POLLUTANTS, digits=V.CORR_DIGITS)


@query("episodes_published", with_ctes(f"""
SELECT CAST(episode AS BIGINT) AS episode, strftime(arg_min(date, date), '%Y-%m-%d') AS debut,
       strftime(arg_max(date, date), '%Y-%m-%d') AS fin, count(*) AS duree,
       {rnd('max(european_aqi)', 1)} AS aqi_max, {rnd('avg(european_aqi)', 1)} AS aqi_moy
FROM isl WHERE bad = 1 GROUP BY episode HAVING count(*) >= 6""", H=H_SQL, isl=_ISL))
def q_episodes(spark, sf):
    """A26 to 1 digit."""
    return W.episodes(station_hourly(spark, sf), ts="date", col="european_aqi", digits=V.EPISODE_DIGITS)


@query("rolling_daily_published", with_ctes(f"""
SELECT date_str, {', '.join(f"{rnd(f'avg({c}_r)', 2)} AS {c}_r" for c in ('pm2_5', 'pm10', 'ozone'))}
FROM (SELECT strftime(date, '%Y-%m-%d') AS date_str,
             {', '.join(f"{rnd(rolling_mean(c, [], 'date', 24, 1), 2)} AS {c}_r" for c in ('pm2_5', 'pm10', 'ozone'))}
      FROM H) GROUP BY 1""", H=H_SQL))
def q_rolling_daily(spark, sf):
    """Rolling means to 2 digits, then their daily means to 2 digits."""
    return W.rolling_daily(station_hourly(spark, sf), cols=["pm2_5", "pm10", "ozone"], digits=V.KPI_DIGITS)


@query("history7_published", with_ctes(f"""
SELECT strftime(c.day, '%Y-%m-%d') AS dates, {rnd('hd.pm2_5', 2)} AS "values"
FROM hcal c LEFT JOIN hd ON c.day = hd.day ORDER BY c.day DESC LIMIT 7""", H=H_SQL, hd=_HD, hcal=_HCAL))
def q_history7(spark, sf):
    """L5 to 2 digits."""
    daily = R.daily_resample(station_hourly(spark, sf), ts="date", value_cols=["pm2_5"])
    return W.history(daily, day_col="day", col="pm2_5", n=7, digits=V.KPI_DIGITS)


# --- monitoring report -------------------------------------------------------------

_W = win([], "day")
_HFX = (f"SELECT day, {', '.join(POLLUTANTS)}, "
        + ", ".join(f"lag(pm2_5, {i}) {_W} AS pm25_lag_{i}, lag(carbon_monoxide, {i}) {_W} AS co_lag_{i}"
                    for i in range(1, 4))
        + f", {rolling_mean('pm2_5', [], 'day', 7)} AS pm25_rolling_7d, "
          "CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month FROM hi")
_HBT = f"""SELECT pm2_5, actual FROM (
  SELECT *, row_number() {_W} AS idx, count(*) OVER () AS n, lead(pm2_5, 1) {_W} AS actual FROM hfx)
WHERE idx <= n - 1 AND idx >= 7 AND idx >= n - 7 AND {' AND '.join(f'{c} IS NOT NULL' for c in _BT_INPUTS)}"""
_BASE = V.BASELINE_METRICS
_LIMIT = L.mae_threshold(_BASE)


@query("monitoring_report", with_ctes(f"""
SELECT total_rows, last_update, CAST(0 AS BIGINT) AS anomalies_detected, pm25_range_violation,
       {', '.join(f'{c}_missing' for c in POLLUTANTS)}, mae, rmse, n_samples,
       {', '.join(f'CAST({v} AS DOUBLE) AS baseline_{k}' for k, v in _BASE.items())},
       coalesce(mae > {_LIMIT}, false) AS needs_retraining,
       concat_ws(' | ', CASE WHEN mae > {_LIMIT} THEN 'Dégradation de la performance (MAE: ' || printf('%.2f', mae)
                             || ' > seuil {_LIMIT:.2f})' END,
                 CASE WHEN pm2_5_missing > 0.1 THEN '{V.REASON_NULLS}' END) AS reasons
FROM (SELECT count(*) AS total_rows, strftime(max(date), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_update,
             CAST(count_if(pm2_5 < 0 OR pm2_5 > 500) AS BIGINT) AS pm25_range_violation,
             {', '.join(f'count_if({c} IS NULL) / count(*) AS {c}_missing' for c in POLLUTANTS)} FROM H),
     (SELECT avg(abs(actual - pm2_5)) AS mae, sqrt(avg((actual - pm2_5) * (actual - pm2_5))) AS rmse,
             nullif(count(*), 0) AS n_samples FROM hbt)""",
    H=H_SQL, hd="SELECT CAST(date AS DATE) AS day, " + ", ".join(f"avg({c}) AS {c}" for c in POLLUTANTS)
    + " FROM H GROUP BY 1", hcal=_HCAL,
    hfull=f"SELECT c.day, {', '.join(f'hd.{c}' for c in POLLUTANTS)} FROM hcal c LEFT JOIN hd ON c.day = hd.day",
    hi=interp_select(POLLUTANTS, [], "day", "hfull", ["day"]), hfx=_HFX, hbt=_HBT))
def q_monitoring_report(spark, sf):
    """S14 + A15 + M11 + M12: the nested monitoring record of the station (persistence back-test),
    written as JSON and read back; all fields but the time."""
    h = station_hourly(spark, sf)
    filled = FT.daily_table(h, ts="date", value_cols=POLLUTANTS)
    return _report(spark, h, L.backtest_metrics(L.backtest_rows(filled, value_cols=POLLUTANTS)))


def _report(spark, hourly, perf):
    report = L.monitoring_report(S.dq_report(hourly, ts="date", cols=POLLUTANTS), perf, baseline=_BASE)
    path = scratch_path(spark, "monitoring")
    files.write_report_json(report, path)
    back = files.read_report_json(spark, path, report.schema)
    q, p, b = "data_quality.", "performance.", "baseline_comparison."
    return back.select(
        F.col(q + "total_rows").alias("total_rows"), F.col(q + "last_update").alias("last_update"),
        F.col(q + "anomalies_detected").cast("long").alias("anomalies_detected"),
        F.col(q + "pm25_range_violation").alias("pm25_range_violation"),
        *[F.col(f"{q}missing_values_pct.{c}").alias(f"{c}_missing") for c in POLLUTANTS],
        *[F.col(p + c).alias(c) for c in ("mae", "rmse", "n_samples")],
        *[F.col(b + k).alias(f"baseline_{k}") for k in _BASE], "needs_retraining",
        F.array_join("reasons", " | ").alias("reasons"))


@query("monitoring_report_model")
def q_monitoring_report_model(spark, sf):
    """S14 with the model's own back-test, as the service runs it: boosted trees fitted on the station's days before the
    last seven predict these days."""
    h = station_hourly(spark, sf)
    filled = FT.daily_table(h, ts="date", value_cols=POLLUTANTS)
    features = [*POLLUTANTS, *FT.DAILY_FEATURES]
    rows = L.backtest_rows(filled, value_cols=POLLUTANTS, flag="used")
    earlier = FT.daily_features(filled).join(rows.filter("used").select("day"), "day", "left_anti")
    tested = rows.filter("used")
    if not earlier.isEmpty():
        tested = L.predict(L.fit_gbt(earlier, features=features, label="pm25_diff"), tested)
    return _report(spark, h, L.backtest_metrics(tested, delta="prediction" if "prediction" in tested.columns else None))


# --- operators that other queries only contain ----------------------------------------

@query("source_fallback_formats", "SELECT o_orderkey, o_totalprice FROM orders")
def q_source_fallback_formats(spark, sf):
    """No Parquet file, no records, then the CSV that is there."""
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    path = scratch_path(spark, "orders-csv")
    orders.write.mode("overwrite").option("header", True).csv(path)
    schema = orders.select("o_orderkey", "o_totalprice").schema
    return files.read_first_available(
        spark, [f"{sf}/no_such_table.parquet", (f"{sf}/no_such_records.json", "records"), (path, "csv")], schema)


@query("flag_fill", """
SELECT event_id, CAST(coalesce(CASE WHEN event_type = 'click' THEN value > 50 END, false) AS INTEGER) AS anomaly
FROM events""")
def q_flag_fill(spark, sf):
    """A flag that only some rows have, missing ones as 0."""
    flag = F.when(F.col("event_type") == "click", F.col("value") > 50)
    return table(spark, sf, "events").select("event_id", flag_to_int(flag).alias("anomaly"))


@query("skip_all_null", with_ctes("\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) > 0 AS has_values FROM U""" for c in POLLUTANTS)
    + "\nUNION ALL\nSELECT 'formaldehyde', false", U=U_SQL))
def q_skip_all_null(spark, sf):
    """The columns that hold at least one value (one column is all null)."""
    u = users_hourly(spark, sf).withColumn("formaldehyde", F.lit(None).cast("double"))
    names = [*POLLUTANTS, "formaldehyde"]
    kept = set(S.skip_all_null(u, names))
    return spark.createDataFrame([(c, c in kept) for c in names], "column string, has_values boolean")


@query("assign_back", """
SELECT l_orderkey, l_linenumber, CAST(max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END)
       OVER (PARTITION BY l_orderkey, l_linenumber) AS INTEGER) AS anomaly
FROM lineitem""")
def q_assign_back(spark, sf):
    """A flag computed for the keys of some rows put back on all rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = ["l_orderkey", "l_linenumber"]
    some = li.filter(F.col("l_quantity") > 45).select(*key, F.lit(1).alias("anomaly")).distinct()
    return J.assign_back(li, some, key=key, cols=["anomaly"], fill={"anomaly": 0}).select(*key, "anomaly")


@query("store_insert", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, value, strftime(date, '%Y-%m-%d') AS day FROM f""", b=_BATCH, f=_FIRST))
def q_store_insert(spark, sf):
    """S7 + S8 with its write: two overlapping batches into a store of the defined schema, the second
    one twice; the stored rows are read back."""
    ev = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("date"), "event_id", "value")
    schema = store.store_schema(["value"], series_cols=["user_id"])
    path = scratch_path(spark, "store")
    for batch in (ev.filter("date < '2024-01-15'"), ev, ev):
        firsts = store.keep_first(batch, ["user_id", "date"], "event_id")
        typed = firsts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in firsts.columns
                                else F.current_timestamp().alias(f.name) for f in schema.fields])
        store.insert_or_ignore(typed, path, ["user_id", "date"], "created_at")
    return spark.read.parquet(path).select("user_id", "date", "value", "day")
