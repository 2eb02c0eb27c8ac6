"""Stand-in series built from the driver tables.

The driver tables hold no pollutant readings, so their roles are played by:

* **H** (one station, hourly): ``events`` averaged per hour and event type, one
  column per type (click -> pm2_5, error -> pm10, purchase -> carbon_monoxide,
  signup -> ozone, view -> european_aqi).
* **U** (many stations, hourly): the same per ``user_id``.
* **O** (daily, seven years): ``orders`` per ``o_orderdate``.
* **LI** (raw rows): ``lineitem`` (quantity as wind speed, price as angle).
* **E**: ``embeddings`` (array column) for the array-response source.

Each builder has a DuckDB twin (``*_SQL``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import nan_to_null
from ..operators.resample import hourly_wide

# --- fixed values: role of each event type ------------------------------------
EVENT_ROLES = {"click": "pm2_5", "error": "pm10", "purchase": "carbon_monoxide",
               "signup": "ozone", "view": "european_aqi"}
POLLUTANTS = list(EVENT_ROLES.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with NaN -> NULL (rule D1)."""
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def station_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: one wide hourly row per hour: date + the five pollutant columns."""
    return hourly_wide(table(spark, sf_dir, "events"), ts="ts", key_col="event_type",
                       value_col="value", mapping=EVENT_ROLES)


def users_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: one wide hourly row per (user_id, hour)."""
    return hourly_wide(table(spark, sf_dir, "events"), ts="ts", key_col="event_type",
                       value_col="value", mapping=EVENT_ROLES, series_cols=["user_id"])


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: orders as a dated series keyed by priority (date, o_orderpriority, value)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("date"), "o_orderpriority",
        F.col("o_totalprice").alias("value"), "o_orderkey")


def _wide_sql(series: str = "") -> str:
    cols = ",\n       ".join(
        f"avg(CASE WHEN event_type = '{k}' THEN value END) AS {v}" for k, v in EVENT_ROLES.items())
    keys = f"{series}, " if series else ""
    group = "1, 2" if series else "1"
    return (f"SELECT {keys}date_trunc('hour', ts) AS date,\n       {cols}\n"
            f"FROM events GROUP BY {group}")


H_SQL = _wide_sql()
U_SQL = _wide_sql("user_id")
O_SQL = ("SELECT o_orderdate AS date, o_orderpriority, o_totalprice AS value, o_orderkey "
         "FROM orders")


def with_ctes(body: str, **ctes: str) -> str:
    """Prefix a query with named CTEs (H=..., U=...)."""
    if not ctes:
        return body
    parts = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"
