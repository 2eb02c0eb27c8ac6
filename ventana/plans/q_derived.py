"""Advised weather features, and statistics of raw rows by radix selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived as D
from ..operators import gram as G
from ..operators import profiles as P
from ..operators import sketches as K
from ..operators import stats as S
from ..session import scratch_path
from ..sources import bucketed, documents
from . import q_io, q_stats  # noqa: F401
from .registry import ORACLES, query
from .sqltext import corr, ts_txt
from .standins import POLLUTANTS, station_hourly, table, with_ctes

TYPES = ["event_type"]

#: W: one hourly weather series per event type, with hours missing.
W_SQL = """
SELECT event_type, date_trunc('hour', ts) AS date, avg(value) AS temperature_2m, max(value) AS apparent_temperature,
       min(value) AS relative_humidity_2m, sum(value) AS surface_pressure, (sum(value) * 3) % 360 AS wind_direction_10m,
       CAST(count(*) AS DOUBLE) AS wind_speed_10m, avg(value) * 2 AS ozone
FROM events GROUP BY 1, 2"""


def weather_hourly(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("date")).agg(
        F.avg(v).alias("temperature_2m"), F.max(v).alias("apparent_temperature"), F.min(v).alias("relative_humidity_2m"),
        F.sum(v).alias("surface_pressure"), (F.sum(v) * 3 % 360).alias("wind_direction_10m"),
        F.count(F.lit(1)).cast("double").alias("wind_speed_10m"), (F.avg(v) * 2).alias("ozone"))


def _over(frame: str) -> str:
    return f"OVER (PARTITION BY event_type ORDER BY date RANGE BETWEEN {frame})"


_3H, _6H = (_over(f"INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING") for h in (3, 6))
_LAST6, _WEEK = (_over(f"INTERVAL {h * 3_600_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW") for h in (6, 168))
_X = f"avg(wind_speed_10m * cos(radians(wind_direction_10m))) {_LAST6}"
_Y = f"avg(wind_speed_10m * sin(radians(wind_direction_10m))) {_LAST6}"


@query("derived_weather", with_ctes(f"""
SELECT event_type, {ts_txt('date')} AS date, apparent_temperature - temperature_2m AS apparent_gap,
       temperature_2m * relative_humidity_2m AS temp_humidity, sin(radians(wind_direction_10m)) AS wind_sin,
       cos(radians(wind_direction_10m)) AS wind_cos, surface_pressure - avg(surface_pressure) {_3H} AS pressure_change_3h,
       avg(ozone) {_6H} AS ozone_lag_6h, avg(relative_humidity_2m) {_WEEK} AS humidity_mean_7d,
       round((degrees(atan2({_Y}, {_X})) + 360) % 360, 6) AS wind_mean_6h
FROM W""", W=W_SQL))
def q_derived_weather(spark, sf):
    """Gap, product, wind sine and cosine, three-hour pressure change, six-hour ozone lag, seven-day humidity and
    six-hour mean wind direction, by the clock, on series with missing hours."""
    out = D.derived_weather(weather_hourly(spark, sf), series_cols=TYPES)
    return out.select("event_type", "date", "apparent_gap", "temp_humidity", "wind_sin", "wind_cos", "pressure_change_3h",
                      "ozone_lag_6h", "humidity_mean_7d", F.round("wind_mean_6h", 6).alias("wind_mean_6h"))


@query("wind_direction_daily", with_ctes("""
SELECT event_type, strftime(date, '%Y-%m-%d') AS day, round((degrees(atan2(y, x)) + 360) % 360, 6) AS wind_mean,
       sqrt(x * x + y * y) / w AS steadiness
FROM (SELECT event_type, date_trunc('day', date) AS date, avg(wind_speed_10m * cos(radians(wind_direction_10m))) AS x,
             avg(wind_speed_10m * sin(radians(wind_direction_10m))) AS y, avg(wind_speed_10m) AS w FROM W GROUP BY 1, 2)""",
    W=W_SQL))
def q_wind_direction_daily(spark, sf):
    """Mean direction of each day's wind (weighted by speed) and how steady it was."""
    return weather_hourly(spark, sf).groupBy("event_type", F.to_date("date").alias("day")).agg(
        F.round(D.mean_direction("wind_direction_10m", "wind_speed_10m"), 6).alias("wind_mean"),
        D.steadiness("wind_direction_10m", "wind_speed_10m").alias("steadiness"))


_RAW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("quantiles_raw", "SELECT l_returnflag, " + ", ".join(
    f"quantile_cont({c}, 0.95) AS {c}_q95, quantile_cont({c}, 0.5) AS {c}_median" for c in _RAW) + " FROM lineitem GROUP BY 1")
def q_quantiles_raw(spark, sf):
    """A9 on raw rows: all columns and groups (one holds half of all rows) in the same rounds."""
    return P.quantiles(table(spark, sf, "lineitem"), value_cols=_RAW, series_cols=["l_returnflag"], distributed=True)


@query("describe_raw", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max
FROM lineitem""" for c in _RAW))
def q_describe_raw(spark, sf):
    """A12 on raw rows."""
    return S.describe(table(spark, sf, "lineitem"), _RAW, distributed=True)


@query("box_stats_raw", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS mean,
                  stddev_pop(l_extendedprice) AS sd, count(l_extendedprice) AS n FROM lineitem GROUP BY 1),
r AS (SELECT l.l_returnflag, l_extendedprice AS x,
             l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
SELECT q.*, lower_whisker, upper_whisker, n_outliers FROM q JOIN (
  SELECT l_returnflag, min(CASE WHEN inside THEN x END) AS lower_whisker, max(CASE WHEN inside THEN x END) AS upper_whisker,
         CAST(count_if(NOT inside) AS BIGINT) AS n_outliers FROM r GROUP BY 1) w ON w.l_returnflag = q.l_returnflag""")
def q_box_stats_raw(spark, sf):
    """A21 on raw rows per group."""
    return S.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], distributed=True)


def _nice_sql(col: str, bins: int) -> str:
    near = "(1 + ({0} - s0) * 100 / width) % 100 < 2"
    return f"""
SELECT '{col}' AS "column", CAST(floor((x - start) / width + 1e-9) AS INTEGER) AS bin, start, width FROM (
  SELECT x, width, CASE WHEN ints = n AND width < 1 THEN lo - width / 2
         WHEN ints = n THEN CASE WHEN s0 - 0.5 + width < lo THEN s0 - 0.5 + width ELSE s0 - 0.5 END
         WHEN mids < n * 0.1 AND (edges > n * 0.3 OR {near.format('lo')} OR {near.format('hi')})
         THEN CASE WHEN s0 + width / 2 < lo THEN s0 + width / 2 ELSE s0 - width / 2 END ELSE s0 END AS start
  FROM (SELECT *, count_if({near.format('x')}) OVER () AS edges, count_if({near.format('(x + width / 2)')}) OVER () AS mids
        FROM (SELECT *, ceil((lo * 1.0001 - hi * 0.0001) / width) * width - width AS s0
              FROM (SELECT *, base * CASE WHEN rough / base < 2 THEN 2 WHEN rough / base < 5 THEN 5 ELSE 10 END AS width
                    FROM (SELECT *, power(10, floor(log10(rough))) AS base
                          FROM (SELECT x, lo, hi, n, ints, (hi - lo) / {bins}.0 AS rough
                                FROM (SELECT CAST({col} AS DOUBLE) AS x FROM lineitem WHERE {col} IS NOT NULL),
                                     (SELECT min({col}) AS lo, max({col}) AS hi, count({col}) AS n,
                                             count_if({col} % 1 = 0) AS ints FROM lineitem)))))))"""


_NICE = {"l_extendedprice": 40, "l_quantity": 30, "l_discount": 50}


@query("histogram_nice", f"""
SELECT "column", bin, start + bin * width AS lo, start + (bin + 1) * width AS hi, count(*) AS n
FROM ({" UNION ALL ".join(_nice_sql(c, b) for c, b in _NICE.items())}) GROUP BY "column", bin, start, width""")
def q_histogram_nice(spark, sf):
    """A20 with drawn bins: prices (any numbers), quantities (whole ones) and discounts (few values, on edges)."""
    li, out = table(spark, sf, "lineitem"), None
    for c, bins in _NICE.items():
        one = S.nice_histogram(li, c, bins).select(F.lit(c).alias("column"), "bin", "lo", "hi", "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- many columns, sketches, documents, bucketed store ---------------------------------

@query("corr_wide", ORACLES["corr_pairwise"])
def q_corr_wide(spark, sf):
    """A17 by matrix products: the station's columns, pairwise complete."""
    return G.corr_wide(station_hourly(spark, sf), POLLUTANTS)


@query("corr_wide_listwise", ORACLES["corr_listwise"])
def q_corr_wide_listwise(spark, sf):
    """A18 by matrix products."""
    return G.corr_wide(station_hourly(spark, sf), POLLUTANTS, listwise=True)


@query("corr_embedding_dims", f"""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT a.d AS dim_a, b.d AS dim_b, round({corr('a.x', 'b.x')}, 9) AS corr
FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.d, b.d""")
def q_corr_embedding_dims(spark, sf):
    """A17 on all dimensions of the embeddings at once (tens to hundreds of columns, thousands of pairs)."""
    e = table(spark, sf, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [str(i) for i in range(n)]
    wide = e.select(*[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return G.corr_wide(wide, names).select(F.col("col_a").cast("long").alias("dim_a"), F.col("col_b").cast("long").alias("dim_b"),
                                           F.round("corr", 9).alias("corr"))


_SPAN = ("2024-01-05", "2024-01-24")


@query("sketch_span", f"""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, true AS p95_within, true AS median_within, true AS users_within
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}' GROUP BY 1""")
def q_sketch_span(spark, sf):
    """A9/A13 over time: a row of sketches per day is written, and a span of days is reported from these alone. Beside the
    counts, whether each answer lies within the stated error of the exact one (which alone needs the rows again)."""
    ev = table(spark, sf, "events")
    path = scratch_path(spark, "sketches")
    K.daily_sketches(ev, ts="ts", value_cols=["value"], distinct_cols=["user_id"], series_cols=["event_type"]) \
        .write.mode("overwrite").partitionBy("day").parquet(path)
    span = F.col("day").between(*[F.to_date(F.lit(d)) for d in _SPAN])
    told = K.merged(spark.read.parquet(path).filter(span), ["event_type"]).select(
        "event_type", "n", K.quantile("value", 0.95).alias("p95"), K.quantile("value", 0.5).alias("median"),
        K.distinct("user_id").alias("users"))
    rows = ev.withColumn("day", F.to_date("ts")).filter(span).join(told, "event_type")

    def off(q, at):
        """Distance of the wanted share from the shares below and up to the estimate."""
        below, upto = F.avg((F.col("value") < F.col(at)).cast("int")), F.avg((F.col("value") <= F.col(at)).cast("int"))
        return F.greatest(below - F.lit(q), F.lit(q) - upto)
    users = F.count_distinct("user_id")
    return rows.groupBy("event_type", "n").agg(
        (off(0.95, "p95") <= K.rank_error()).alias("p95_within"), (off(0.5, "median") <= K.rank_error()).alias("median_within"),
        (F.abs(F.max("users") - users) <= 4 * K.distinct_error() * users).alias("users_within"))


_TEXT = """CASE event_type WHEN 'click' THEN '{"id": ' || event_id || ', "props": ' || props || '}'
  WHEN 'view' THEN '{"id": "' || event_id || '", "props": null}'
  WHEN 'error' THEN '{"id": ' || event_id || ', "tags": ["a", 1], "late": true}'
  ELSE '{"id": ' || event_id || ', "props": ' || props || ', "user": {"n": ' || user_id || '}}' END"""


def _documents(spark, sf):
    return documents.parsed(table(spark, sf, "events").withColumn("text", F.expr(_TEXT)), "text")


@query("variant_types", """
SELECT event_type, path, type, count(*) AS n FROM (
  SELECT event_type, unnest(CASE event_type
    WHEN 'click' THEN [{'path': '$.id', 'type': 'BIGINT'}, {'path': '$.props', 'type': 'OBJECT'}, {'path': '$.props.k', 'type': 'BIGINT'}]
    WHEN 'view' THEN [{'path': '$.id', 'type': 'STRING'}, {'path': '$.props', 'type': 'VOID'}]
    WHEN 'error' THEN [{'path': '$.id', 'type': 'BIGINT'}, {'path': '$.tags', 'type': 'ARRAY'}, {'path': '$.late', 'type': 'BOOLEAN'}]
    ELSE [{'path': '$.id', 'type': 'BIGINT'}, {'path': '$.props', 'type': 'OBJECT'}, {'path': '$.props.k', 'type': 'BIGINT'},
          {'path': '$.user', 'type': 'OBJECT'}, {'path': '$.user.n', 'type': 'BIGINT'}] END, recursive := true) FROM events)
GROUP BY ALL""")
def q_variant_types(spark, sf):
    """The fields of documents without a common schema, and the types they occur with."""
    return documents.field_types(_documents(spark, sf), "document", ["event_type"])


@query("variant_fields", """
SELECT event_id, event_id AS id, CASE WHEN event_type NOT IN ('view', 'error') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
       CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN CAST(user_id AS DOUBLE) END AS user_n,
       CASE WHEN event_type = 'error' THEN 'a' END AS first_tag, CASE WHEN event_type = 'error' THEN 'true' END AS late
FROM events""")
def q_variant_fields(spark, sf):
    """Typed columns read by path; absent fields are null."""
    return documents.with_fields(_documents(spark, sf), "document", {
        "id": ("$.id", "bigint"), "k": ("$.props.k", "double"), "user_n": ("$.user.n", "double"),
        "first_tag": ("$.tags[0]", "string"), "late": ("$.late", "boolean")}) \
        .select("event_id", "id", "k", "user_n", "first_tag", F.col("late").cast("string").alias("late"))


@query("bucketed_insert", with_ctes(f"SELECT user_id, {ts_txt('date')} AS date, event_id, value FROM f",
                                    b=q_io._BATCH, f=q_io._FIRST))
def q_bucketed_insert(spark, sf):
    """S8/J3 with a store that is bucketed by its key: two overlapping batches and one of them again."""
    ev = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("date"), "event_id", "value")
    path = scratch_path(spark, "bucketed")
    name = "store_" + path.rsplit("-", 1)[-1]
    bucketed.create(spark, name, ev.schema, ["user_id", "date"], buckets=8, path=path)
    for batch in (ev.filter("date < '2024-01-15'"), ev, ev):
        bucketed.insert_or_ignore(batch, name, "event_id")
    return spark.table(name)
