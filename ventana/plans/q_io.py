"""Sources, keyed store and streams (phase 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import api, files, store
from ..streaming import ingest, joined, ordered
from . import q_windows  # noqa: F401  (its SQL is that of the streamed twins)
from .registry import ORACLES, query
from .sqltext import ts_txt
from .standins import H_SQL, POLLUTANTS, U_SQL, station_hourly, table, users_hourly, with_ctes


def _scratch(spark, name):
    return scratch_path(spark, f"table-{name}")


@query("array_response", """
SELECT vec_id, strftime(TIMESTAMP '1970-01-01' + to_seconds(vec_id * 86400 + 3600 + pos * 3600),
                        '%Y-%m-%d %H:%M:%S') AS date,
       CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value, CAST(value_rev AS DOUBLE) AS value_rev
FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value,
             unnest(list_reverse(embedding)) AS value_rev FROM embeddings)""")
def q_array_response(spark, sf):
    """Each embedding as an API response (start, end exclusive, step, offset,
    two variable arrays) expanded to one row per time step."""
    e = table(spark, sf, "embeddings")
    resp = e.select("vec_id", (F.col("vec_id") * 86400).alias("start"),
                    (F.col("vec_id") * 86400 + F.size("embedding") * 3600).alias("end"),
                    F.lit(3600).alias("step_s"), F.lit(3600).alias("utc_offset_s"),
                    F.col("embedding").alias("value"), F.reverse("embedding").alias("value_rev"))
    return api.expand_response(resp, variables=["value", "value_rev"], keep=["vec_id"])


@query("json_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_json_records(spark, sf):
    """JSON text per row -> typed columns."""
    return files.explode_records(table(spark, sf, "events"), "props", "k int", key=None,
                                 keep=["event_id"])


_BATCH = """SELECT user_id, date_trunc('hour', ts) AS date, event_id, event_type, value FROM events"""
_FIRST = """SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY event_id) = 1"""


@query("insert_or_ignore", with_ctes(f"""
SELECT f.user_id, {ts_txt('f.date')} AS date, f.event_id, f.event_type, f.value FROM f
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = f.user_id AND t.date = f.date)""",
    b=_BATCH, f=_FIRST, t="SELECT DISTINCT user_id, date FROM b WHERE date < TIMESTAMP '2024-01-15'"))
def q_insert_or_ignore(spark, sf):
    """Keep-first per (series, hour) inside the batch, minus keys already
    stored (the store holds everything before 2024-01-15)."""
    ev = table(spark, sf, "events").select(
        "user_id", F.date_trunc("hour", "ts").alias("date"), "event_id", "event_type", "value")
    stored = store.keep_first(ev.filter(F.col("date") < F.lit("2024-01-15").cast("timestamp_ntz")),
                              ["user_id", "date"], "event_id")
    return store.new_rows(ev, stored, ["user_id", "date"], "event_id", ts="date")


@query("keep_first_null_orders", f"""
SELECT user_id, {ts_txt("date_trunc('hour', ts)")} AS date, coalesce(min(CASE WHEN event_type <> 'click' THEN event_id END), -1) AS seq,
       count(DISTINCT event_type) >= 1 AS kept FROM events GROUP BY 1, 2""")
def q_keep_first_null_orders(spark, sf):
    """Readings whose order is unknown (null) come last, and a key that has no others keeps one of them."""
    ev = table(spark, sf, "events").select(
        "user_id", F.date_trunc("hour", "ts").alias("date"), F.when(F.col("event_type") != "click", F.col("event_id")).alias("seq"),
        "event_id", "event_type", "value")
    return store.keep_first(ev, ["user_id", "date"], "seq").select(
        "user_id", "date", F.coalesce("seq", F.lit(-1)).alias("seq"), F.lit(True).alias("kept"))


@query("high_water", with_ctes(f"""
SELECT s.user_id, {ts_txt('l.last_ts')} AS last_ts,
       strftime(coalesce(CAST(l.last_ts AS DATE) + INTERVAL 1 DAY, DATE '2025-09-30'), '%Y-%m-%d') AS start_date,
       '2026-01-01' AS end_date
FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) s
LEFT JOIN (SELECT user_id, max(date) AS last_ts FROM U GROUP BY 1) l ON s.user_id = l.user_id
WHERE coalesce(CAST(l.last_ts AS DATE) + INTERVAL 1 DAY, DATE '2025-09-30') <= DATE '2026-01-01'""",
    U=U_SQL))
def q_high_water(spark, sf):
    """Next start date per series (customers without rows back-fill)."""
    series = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return store.high_water(users_hourly(spark, sf), series, key="user_id", end="2026-01-01")


@query("due_series", f"""
SELECT s.user_id, {ts_txt('l.last_collect')} AS last_collect,
       l.last_collect IS NULL OR l.last_collect <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 DAYS AS due
FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) s
LEFT JOIN (SELECT user_id, max(ts) AS last_collect FROM events GROUP BY 1) l ON s.user_id = l.user_id""")
def q_due_series(spark, sf):
    """Series due for collection at a fixed 'now' (never, or >= 2 days ago)."""
    log = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_collect"))
    series = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return store.due_series(log, series, key="user_id", now="2024-01-30 12:00:00")


@query("csv_roundtrip", with_ctes(f"SELECT {ts_txt('date')} AS date, {', '.join(POLLUTANTS)} FROM H",
                                  H=H_SQL))
def q_csv_roundtrip(spark, sf):
    """S9 then S1: export the station table as ordered CSV and scan it back."""
    path = _scratch(spark, "csv")
    files.write_csv(station_hourly(spark, sf), path, cols=["date", *POLLUTANTS], ts="date")
    schema = "date string, " + ", ".join(f"{c} double" for c in POLLUTANTS)
    return files.read_series_csv(spark, path, schema, ts="date")


@query("parquet_export", with_ctes(
    f"SELECT {ts_txt('date')} AS date, {', '.join(POLLUTANTS)}, strftime(date, '%Y-%m-%d') AS day FROM H",
    H=H_SQL))
def q_parquet_export(spark, sf):
    """Export by day (range-partitioned, sorted) + CSV, read the Parquet back."""
    pq, csv = _scratch(spark, "pq"), _scratch(spark, "csv2")
    files.export_both(station_hourly(spark, sf), csv, pq, ts="date")
    return files.read_series_parquet(spark, pq)


def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return ingest.read_stream(spark, f"{sf}/events.parquet", schema, event_ts="ts")


@query("stream_dedup", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, event_id, event_type, value, strftime(date, '%Y-%m-%d') AS day
FROM f""", b=_BATCH, f=_FIRST))
def q_stream_dedup(spark, sf):
    """Streamed keep-first insert (foreachBatch -> S8) into a Parquet store."""
    out, ck = ingest.new_paths(spark, "dedup")
    s = _events_stream(spark, sf).select(
        "user_id", F.date_trunc("hour", "ts").alias("date"), "event_id", "event_type", "value")
    ingest.run_to_end(ingest.stream_insert(s, out, ck, key=["user_id", "date"],
                                           order_col="event_id", ts="date"))
    return spark.read.parquet(out)


@query("stream_daily", f"""
SELECT user_id, {ts_txt("date_trunc('day', ts)")} AS day_start, avg(value) AS mean, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_stream_daily(spark, sf):
    """Watermarked daily window means per series, latest version per window."""
    out, ck = ingest.new_paths(spark, "daily")
    ingest.run_to_end(ingest.stream_daily(_events_stream(spark, sf), out, ck, ts="ts",
                                          value_col="value", series_cols=["user_id"]))
    return ingest.latest_versions(spark.read.parquet(out), ["user_id", "day_start"])


@query("stream_alerts", f"""
SELECT event_id, {ts_txt('ts')} AS ts, value,
       CASE WHEN value <= 55.0 THEN 'Mauvais' ELSE 'Très Mauvais' END AS aqi_label
FROM events WHERE value > 35.0""")
def q_stream_alerts(spark, sf):
    """Stateless label + filter on the stream."""
    out, ck = ingest.new_paths(spark, "alerts")
    ingest.run_to_end(ingest.stream_alerts(_events_stream(spark, sf), out, ck, value_col="value",
                                           keep=["event_id", "ts"]))
    return spark.read.parquet(out)


def _landed(spark, rows, name, ts, cuts):
    """A landing folder that ``rows`` reach in parts cut at times, one after the other; yields after each part."""
    land = ingest.new_paths(spark, name)[0]
    at = F.col(ts)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows
        if lo:
            part = part.filter(at >= F.lit(lo).cast("timestamp_ntz"))
        if hi:
            part = part.filter(at < F.lit(hi).cast("timestamp_ntz"))
        part.write.mode("append").parquet(land)
        yield land


_CUTS = ["2024-01-11", "2024-01-21 07:30:00"]


@query("stream_episodes", ORACLES["episodes_raw"])
def q_stream_episodes(spark, sf):
    """A26/W8 on a stream: runs above 60 go on across micro-batches and restarts; the events arrive in three
    parts, each read by a query started anew from the checkpoint. Equals the batch query over all rows."""
    out, ck = ingest.new_paths(spark, "episodes")
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    for land in _landed(spark, ev, "landing", "ts", _CUTS):
        s = ingest.read_stream(spark, land, ev.schema, event_ts="ts")
        ingest.run_to_end(ordered.stream_episodes(s, out, ck, ts="ts", value="value", tiebreak="event_id",
                                                  series_cols=["user_id"], watermark="2 days"))
    return ordered.results(spark, out, ["user_id"]).select(
        "user_id", "episode", "debut", "fin", "duree", "aqi_max", "aqi_moy")


@query("stream_lags", """
SELECT user_id, event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3 FROM events
WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_stream_lags(spark, sf):
    """W1 on a stream, in three parts with restarts."""
    out, ck = ingest.new_paths(spark, "lags")
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    for land in _landed(spark, ev, "landing", "ts", _CUTS):
        s = ingest.read_stream(spark, land, ev.schema, event_ts="ts")
        ingest.run_to_end(ordered.stream_lags(s, out, ck, ts="ts", value="value", tiebreak="event_id",
                                              series_cols=["user_id"], offsets=[1, 3], watermark="2 days"))
    return ordered.results(spark, out, ["user_id"]).select("user_id", "event_id", "value", "lag_1", "lag_3")


@query("stream_merge", f"""
SELECT a.user_id, {ts_txt('a.date')} AS date, pm2_5, pm10, temperature_2m FROM
 (SELECT user_id, date_trunc('hour', ts) AS date, avg(value) AS pm2_5, max(value) AS pm10 FROM events
  WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2) a
JOIN (SELECT user_id, date_trunc('hour', ts) AS date, avg(value) AS temperature_2m FROM events
      WHERE event_type NOT IN ('click', 'error') GROUP BY 1, 2) m ON a.user_id = m.user_id AND a.date = m.date""")
def q_stream_merge(spark, sf):
    """J1 on streams: hourly pollutant and weather rows joined by series and hour while both arrive in parts."""
    out, ck = ingest.new_paths(spark, "merge")
    ev = table(spark, sf, "events").withColumn("date", F.date_trunc("hour", "ts"))
    air = ev.filter(F.col("event_type").isin("click", "view", "error")).groupBy("user_id", "date") \
        .agg(F.avg("value").alias("pm2_5"), F.max("value").alias("pm10"))
    met = ev.filter(~F.col("event_type").isin("click", "error")).groupBy("user_id", "date") \
        .agg(F.avg("value").alias("temperature_2m"))
    for left, right in zip(_landed(spark, air, "air", "date", _CUTS), _landed(spark, met, "weather", "date", _CUTS)):
        ingest.run_to_end(joined.stream_merge(
            ingest.read_stream(spark, left, air.schema, event_ts="date"),
            ingest.read_stream(spark, right, met.schema, event_ts="date"), out, ck, on=["user_id", "date"], ts="date",
            watermark="1 day"))
    return spark.read.parquet(out).select("user_id", "date", "pm2_5", "pm10", "temperature_2m")


# --- ordered table, source fallback, JSON report --------------------------------

from ..operators import columns as C  # noqa: E402
from ..operators import profiles as P  # noqa: E402
from ..operators import stats as S  # noqa: E402


@query("ordered_table", with_ctes(f"SELECT {ts_txt('date')} AS date, pm2_5, pm10 FROM H", H=H_SQL))
def q_ordered_table(spark, sf):
    """S3: a catalog table read with a fixed column list, ordered by time."""
    station_hourly(spark, sf).createOrReplaceTempView("hourly_air_quality")
    return files.read_ordered_table(spark, "hourly_air_quality", ["date", "pm2_5", "pm10"], ts="date")


@query("source_fallback", "SELECT o_orderkey, o_totalprice FROM orders")
def q_source_fallback(spark, sf):
    """The first source that exists (a missing Parquet path is skipped)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()),
                           T.StructField("o_totalprice", T.DoubleType())])
    df = files.read_first_available(spark, [f"{sf}/no_such_table.parquet", f"{sf}/orders.parquet"],
                                    schema)
    return df.select("o_orderkey", "o_totalprice")


@query("report_json", with_ctes(f"""
SELECT count(*) AS total_rows, strftime(max(date), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_update,
       CAST(count_if(pm2_5 < 0 OR pm2_5 > 500) AS BIGINT) AS pm25_range_violation,
       count_if(pm2_5 IS NULL) / count(*) AS pm2_5_missing,
       count_if(ozone IS NULL) / count(*) AS ozone_missing
FROM H""", H=H_SQL))
def q_report_json(spark, sf):
    """S14 + A15: the data-quality report written as JSON and read back."""
    path = _scratch(spark, "report")
    rep = S.dq_report(station_hourly(spark, sf), ts="date", cols=["pm2_5", "ozone"])
    files.write_report_json(rep, path)
    back = files.read_report_json(spark, path)
    return back.select(F.col("total_rows").cast("bigint").alias("total_rows"), "last_update",
                       F.col("pm25_range_violation").cast("bigint").alias("pm25_range_violation"),
                       F.col("missing_values_pct.pm2_5").cast("double").alias("pm2_5_missing"),
                       F.col("missing_values_pct.ozone").cast("double").alias("ozone_missing"))


_FEATS = ["pm2_5", "pm10", "ozone", "nitrogen_dioxide", "european_aqi"]


@query("align_features", with_ctes(f"""
SELECT user_id, {ts_txt('date')} AS date, pm2_5, pm10, ozone, CAST(NULL AS DOUBLE) AS nitrogen_dioxide, european_aqi
FROM U WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL""", U=U_SQL))
def q_align_features(spark, sf):
    """P19 -> U2/P17 -> P14 -> P18: numeric columns, missing features added as
    NULL in model order, then rows complete on the two PM features kept."""
    u = C.numeric_only(users_hourly(spark, sf), keep=["date"])
    assert C.missing_columns(u, _FEATS) == ["nitrogen_dioxide"]
    aligned = C.align_features(C.drop_if_present(u, ["carbon_monoxide", "id"]), _FEATS,
                               keep=["user_id", "date"])
    return C.complete_rows(aligned, ["pm2_5", "pm10"])


@query("batch_bounds", f"""
SELECT user_id, {ts_txt('min(ts)')} AS first_ts, {ts_txt('max(ts)')} AS last_ts, count(*) AS n_rows
FROM events GROUP BY 1""")
def q_batch_bounds(spark, sf):
    """first/last time and row count per series of a batch."""
    return P.batch_bounds(table(spark, sf, "events"), ts="ts", series_cols=["user_id"])


@query("first_last", """
SELECT user_id, arg_min(value, (ts, event_id)) AS value_first, arg_max(value, (ts, event_id)) AS value_last
FROM events GROUP BY 1""")
def q_first_last(spark, sf):
    """First and last value by time per series (ties broken by event id)."""
    from ..operators import windows as W
    ev = table(spark, sf, "events")
    return W.first_last(ev, ts="ts", cols=["value"], series_cols=["user_id"], tiebreak="event_id")


@query("cumulative", """
SELECT o_orderpriority, strftime(d, '%Y-%m-%d') AS day, total,
       sum(total) OVER (PARTITION BY o_orderpriority ORDER BY d
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total
FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS total
      FROM orders GROUP BY 1, 2)""")
def q_cumulative(spark, sf):
    """Running total per series over daily sums."""
    from ..operators import windows as W
    d = table(spark, sf, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")) \
        .agg(F.sum("o_totalprice").alias("total"))
    return W.cumulative_sum(d, order_col="day", col="total", out="running_total",
                            series_cols=["o_orderpriority"])
