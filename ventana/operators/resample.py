"""Calendar resampling (A1-A3).

Raw rows go through one hash aggregation per (series, day) with map-side partial
aggregation, so a hot series only costs its share of the scan; the calendar gaps
are then filled on the (small) daily grid, in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rounded

AGGS = {
    "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum,
    "count": F.count, "median": F.median, "std": F.stddev_samp,
    # exact medians keep a group's values in memory; the sketch is fixed-size
    "approx_median": lambda c: F.percentile_approx(c, 0.5, 10000),
}


def _agg_exprs(value_cols: Sequence[str] | None, aggs: Sequence[tuple] | None,
               digits: int | None) -> tuple[list[Column], list[str]]:
    """Build named aggregates; returns them and the names of sum outputs."""
    exprs, sums = [], []
    if aggs:
        for out, fn, src in aggs:
            exprs.append(rounded(AGGS[fn](F.col(src)), digits).alias(out))
            if fn == "sum":
                sums.append(out)
    else:
        exprs = [rounded(F.avg(c), digits).alias(c) for c in value_cols]
    return exprs, sums


def daily_mean(df: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
               series_cols: Sequence[str] = (), day_col: str = "date_str",
               digits: int | None = None) -> DataFrame:
    """A1: mean per day text, no calendar (rule D11)."""
    return (df.groupBy(*series_cols, F.date_format(ts, "yyyy-MM-dd").alias(day_col))
              .agg(*[rounded(F.avg(c), digits).alias(c) for c in value_cols]))


def calendar(bounds: DataFrame, *, series_cols: Sequence[str] = (), lo: str = "lo",
             hi: str = "hi", day_col: str = "day", step: str = "1 day") -> DataFrame:
    """One row per step between per-series bounds (inclusive).

    ``bounds`` has one row per series, so this is bounded by the number of
    series times the span, never by the raw row count.
    """
    return bounds.select(*series_cols, F.explode(
        F.sequence(F.col(lo), F.col(hi), F.expr(f"INTERVAL {step}"))).alias(day_col))


def daily_resample(df: DataFrame, *, ts: str = "date", value_cols: Sequence[str] | None = None,
                   series_cols: Sequence[str] = (), aggs: Sequence[tuple] | None = None,
                   day_col: str = "day", digits: int | None = None,
                   as_of: str | None = None) -> DataFrame:
    """A2/A3: resample to days with a full calendar per series (rule D10).

    Rows stamped after ``as_of`` (e.g. forecast hours of today already in the
    feed, rule D4) are left out when it is given; by default they are kept,
    as the reference keeps them. The cut is a plain filter, pushed to the scan.

    ``aggs`` is a list of ``(output, function, column)``; without it every
    column in ``value_cols`` is averaged. Empty days get NULL for mean/min/max
    and 0 for sums, as a day-bin of no rows does.

    One pass over the raw rows: after the (series, day) aggregation, each day
    row is expanded to itself plus the empty days up to the next present day
    (``lead`` over the small daily grid + ``explode(sequence)``), so there is no
    second scan for calendar bounds and no join.
    """
    exprs, sums = _agg_exprs(value_cols, aggs, digits)
    if as_of is not None:
        df = df.filter(F.col(ts) <= F.lit(as_of).cast(df.schema[ts].dataType))
    daily = (df.withColumn(day_col, F.to_date(ts))
               .groupBy(*series_cols, day_col).agg(*exprs))
    outs = [c for c in daily.columns if c not in (*series_cols, day_col)]
    w = Window.partitionBy(*series_cols).orderBy(day_col)
    last_day = F.coalesce(F.date_sub(F.lead(day_col).over(w), 1), F.col(day_col))
    spread = daily.withColumn("_last", last_day) \
        .withColumn("_d", F.explode(F.sequence(F.col(day_col), F.col("_last"))))
    own = F.col("_d") == F.col(day_col)
    cols = []
    for c in outs:
        dtype = daily.schema[c].dataType
        empty = F.lit(0).cast(dtype) if c in sums else F.lit(None).cast(dtype)
        value = F.coalesce(F.col(c), F.lit(0).cast(dtype)) if c in sums else F.col(c)
        cols.append(F.when(own, value).otherwise(empty).alias(c))
    return spread.select(*series_cols, F.col("_d").alias(day_col), *cols)


def hourly_wide(df: DataFrame, *, ts: str, key_col: str, value_col: str,
                mapping: dict[str, str], series_cols: Sequence[str] = (),
                out_ts: str = "date") -> DataFrame:
    """Long readings -> one row per (series, hour), one averaged column per key.

    Same as ``groupBy(..).pivot(key, values).avg(value)`` with the values given,
    written as conditional averages so it is a single aggregation pass.
    """
    # date_trunc yields a session-zone TIMESTAMP; cast back so naive input stays naive
    hour = F.date_trunc("hour", F.col(ts)).cast(df.schema[ts].dataType)
    return (df.groupBy(*series_cols, hour.alias(out_ts))
              .agg(*[F.avg(F.when(F.col(key_col) == k, F.col(value_col))).alias(name)
                     for k, name in mapping.items()]))
