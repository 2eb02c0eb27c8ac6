"""Joins (J1, J2, J4, J5) and the threshold table.

Both sides of J1 are aggregated time grids keyed by (series, ts); joining on
that key lets Catalyst reuse the aggregation's hash partitioning (no extra
exchange on the sides). Lookup tables here are fixed lists of a few rows, so
broadcasting them is safe by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import gauge_class, safe_div, with_unit


def merge_sources(left: DataFrame, right: DataFrame, *, on: Sequence[str],
                  required: Sequence[str] = ("pm10", "pm2_5", "temperature_2m"),
                  observations: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Inner equi-join on (series, ts), then drop rows null in ``required``.

    With ``observations`` (two ``pyspark.sql.Observation``), the joined and the
    kept row counts are collected by the job that runs the result -- the rows
    lost to the null filter are reported without an extra pass.
    """
    joined = left.join(right, list(on), "inner")
    if observations:
        joined = joined.observe(observations[0], F.count(F.lit(1)).alias("rows"))
    out = joined.dropna(subset=[c for c in required if c in joined.columns])
    if observations:
        out = out.observe(observations[1], F.count(F.lit(1)).alias("rows"))
    return out


def flagged_days(daily: DataFrame, daily_flag: DataFrame, *, day_col: str = "date_str",
                 flag_col: str = "anomaly", series_cols: Sequence[str] = ()) -> DataFrame:
    """Left join of daily values with the daily flag; keep flagged days."""
    return (daily.join(daily_flag, [*series_cols, day_col], "left")
                 .filter(F.col(flag_col) == 1))


def flagged_days_fused(df: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
                       flag_col: str = "anomaly", series_cols: Sequence[str] = (),
                       day_col: str = "date_str") -> DataFrame:
    """J2 when the daily values and the daily flag come from the same rows:
    one aggregation (means and max flag per day) instead of joining two
    aggregates of one input, which reads it twice. Same rows as
    ``flagged_days(daily_mean(df), daily_flag_max(df))``."""
    day = F.date_format(F.col(ts), "yyyy-MM-dd").alias(day_col)
    return (df.groupBy(*series_cols, day)
              .agg(*[F.avg(c).alias(c) for c in value_cols], F.max(flag_col).alias(flag_col))
              .filter(F.col(flag_col) == 1))


def limits_frame(spark, limits: dict[str, float] | None = None,
                 index_col: str | None = None) -> DataFrame:
    """Fixed lookup table of guideline limits (a handful of rows), plus the
    mean-index limit when ``index_col`` is given."""
    limits = V.GUIDELINE_LIMITS if limits is None else limits
    rows = [(k, float(v), i, False) for i, (k, v) in enumerate(limits.items())]
    if index_col:
        rows.append((index_col, float(V.INDEX_LIMIT), len(rows), True))
    return spark.createDataFrame(rows, "measure string, limit double, measure_order int, "
                                       "is_index boolean")


def threshold_status(means: DataFrame, *, measures: Sequence[str] | None = None,
                     limits: dict[str, float] | None = None, index_col: str | None = None,
                     series_cols: Sequence[str] = ()) -> DataFrame:
    """Per measure: value, limit, ratio, delta, colour class, status, texts.

    ``means`` has one column per measure (e.g. a KPI row). It is unpivoted to
    (measure, value) and joined to the fixed limits table (broadcast: fixed
    size, independent of the data). With ``index_col`` the mean index gets its
    row too (limit 50, status "Élevé" above it, texts without unit).
    """
    limits = V.GUIDELINE_LIMITS if limits is None else limits
    measures = [m for m in (measures or list(limits)) if m in means.columns]
    if index_col and index_col in means.columns and index_col not in measures:
        measures.append(index_col)
    long = means.unpivot(list(series_cols), measures, "measure", "value") if series_cols else \
        means.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"),
                                                 F.col(m).cast("double").alias("value"))
                                        for m in measures])))
    lim = F.broadcast(limits_frame(means.sparkSession, limits, index_col))
    out = long.join(lim, "measure", "inner")
    idx = F.col("is_index")
    within = F.col("value") <= F.col("limit")
    status = F.when(within, V.STATUS_OK).when(idx, V.STATUS_HIGH).otherwise(V.STATUS_OVER)
    number = F.translate(F.format_number("value", 2), ",", "")
    limit_num = F.col("limit").cast("int").cast("string")
    return out.select(
        *series_cols, "measure", "measure_order", "value", "limit",
        safe_div("value", "limit").alias("ratio"),
        (F.col("value") - F.col("limit")).alias("delta"),
        gauge_class("value", "limit").alias("gauge_class"),
        status.alias("status"),
        F.when(idx, number).otherwise(with_unit("value")).alias("value_text"),
        F.when(idx, limit_num).otherwise(F.format_string(f"%s {V.UNIT}", limit_num))
        .alias("limit_text"))


def assign_back(all_rows: DataFrame, subset_result: DataFrame, *, key: Sequence[str],
                cols: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Put a result computed on a subset back on every row by key; rows
    outside the subset get ``fill`` (e.g. anomaly 0)."""
    out = all_rows.join(subset_result.select(*key, *cols), list(key), "left")
    return out.fillna(fill) if fill else out
