"""Profiles, shares, KPIs, peaks.

All are single hash aggregations with partial (map-side) combine; the outputs
are a handful of rows (24 hours, 12 months, 3 levels), so the only shuffle is
that of the partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import index_label, level3, month_label, rounded, safe_div, weekday
from . import radix


def hour_profile(df: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
                 series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """A4: mean per hour of day."""
    return (df.groupBy(*series_cols, F.hour(ts).alias("hour"))
              .agg(*[rounded(F.avg(c), digits).alias(c) for c in value_cols]))


def month_profile(df: DataFrame, *, ts: str = "date", value_cols: Sequence[str],
                  series_cols: Sequence[str] = (), digits: int | None = None,
                  labels: dict[int, str] | None = None) -> DataFrame:
    """A5: mean per calendar month (years merged) with the month label."""
    return (df.groupBy(*series_cols, F.month(ts).alias("month"))
              .agg(*[rounded(F.avg(c), digits).alias(c) for c in value_cols])
              .withColumn("month_label", month_label("month", labels)))


def weekday_hour_pivot(df: DataFrame, *, ts: str = "date", value_col: str,
                       series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Weekday (Mon=0) x hour-of-day table of means, hours as columns h0..h23.

    The 24 hour values are fixed, so the pivot needs no distinct-value pass.
    """
    hours = list(range(24))
    return (df.withColumn("_h", F.hour(ts))
              .groupBy(*series_cols, weekday(ts).alias("dayofweek"))
              .pivot("_h", hours)
              .agg(rounded(F.avg(value_col), digits))
              .withColumnsRenamed({str(h): f"h{h}" for h in hours}))


def level_shares(df: DataFrame, *, level_col: str = "aqi_level",
                 levels: Sequence[str] = tuple(V.LEVEL3_LABELS),
                 digits: int | None = None, series_cols: Sequence[str] = ()) -> DataFrame:
    """Count and share (% of all rows) per level, every level listed (absent
    levels with 0), per series when ``series_cols`` are given.

    One aggregation: a conditional count per level of the fixed list plus the
    row count, then ``inline`` into one row per level -- no join against a level
    table, no window, no second pass.
    """
    lv = F.col(level_col)
    counts = df.groupBy(*series_cols).agg(
        *[F.count_if(lv == F.lit(v)).alias(f"_n{i}") for i, v in enumerate(levels)],
        F.count(F.lit(1)).alias("_rows"))
    total = F.nullif(F.col("_rows"), F.lit(0))
    return counts.select(*series_cols, F.inline(F.array(*[
        F.struct(F.lit(v).alias(level_col), F.lit(i).alias("level_order"),
                 F.col(f"_n{i}").alias("n"),
                 rounded(F.col(f"_n{i}") * 100.0 / total, digits).alias("share_pct"))
        for i, v in enumerate(levels)])))


def level_hours(df: DataFrame, *, value_col: str = "pm2_5") -> DataFrame:
    """Hours above 35.5, in (12, 35.5], and at most 12."""
    x = F.col(value_col)
    lo, hi = V.LEVEL3_BOUNDS
    return df.agg(F.count_if(x > hi).alias("hours_bad"),
                  F.count_if((x > lo) & (x <= hi)).alias("hours_moderate"),
                  F.count_if(x <= lo).alias("hours_good"))


def quantiles(df: DataFrame, *, value_cols: Sequence[str], series_cols: Sequence[str] = (),
              q: float = 0.95, approx: bool = False, accuracy: int = 10000,
              distributed: bool = False) -> DataFrame:
    """The q-quantile (linear interpolation) and median of each column.

    The plain form holds a group's distinct values in one buffer, which calendar grids
    bound. For raw rows, ``distributed=True`` gives the same numbers by radix selection of all
    columns and groups at once (``radix``), ``approx=True`` a bounded-memory sketch.
    """
    if distributed:
        return radix.quantiles_wide(df, value_cols, {f"q{int(q * 100)}": q, "median": 0.5}, series_cols)
    exprs = []
    for c in value_cols:
        if approx:
            exprs += [F.percentile_approx(c, q, accuracy).alias(f"{c}_q{int(q * 100)}"),
                      F.percentile_approx(c, 0.5, accuracy).alias(f"{c}_median")]
        else:
            exprs += [F.percentile(c, q).alias(f"{c}_q{int(q * 100)}"),
                      F.median(c).alias(f"{c}_median")]
    return df.groupBy(*series_cols).agg(*exprs)


def kpi_row(df: DataFrame, *, mean_cols: Sequence[str] = ("pm2_5", "pm10", "ozone"),
            index_col: str = "european_aqi", pm25: str = "pm2_5", pm10: str = "pm10",
            anomaly_col: str | None = None, series_cols: Sequence[str] = (),
            digits: int | None = V.KPI_DIGITS, approx: bool = False) -> DataFrame:
    """A10 (+P8): means, P95 of PM2.5, mean PM ratio, index label, anomaly count.

    The index is labelled after rounding to ``digits``, as published.
    """
    exprs = [rounded(F.avg(c), digits).alias(f"{c}_mean") for c in mean_cols]
    p95 = F.percentile_approx(pm25, 0.95, 10000) if approx else F.percentile(pm25, 0.95)
    exprs += [rounded(p95, digits).alias(f"{pm25}_p95"),
              rounded(F.avg(safe_div(pm25, pm10)), digits).alias("pm_ratio_mean"),
              rounded(F.avg(index_col), digits).alias("index_mean"),
              F.count(F.lit(1)).alias("n_rows")]
    if anomaly_col:
        exprs.append(F.sum(F.coalesce(F.col(anomaly_col), F.lit(0))).cast("bigint")
                     .alias("n_anomalies"))
    out = df.groupBy(*series_cols).agg(*exprs)
    return out.withColumn("index_label", index_label("index_mean"))


def dominant_level(df: DataFrame, *, value_col: str = "pm2_5",
                   series_cols: Sequence[str] = (), digits: int | None = V.KPI_DIGITS) -> DataFrame:
    """Worst level whose share of rows, rounded to ``digits`` as published, is above 50 %,
    else the best level."""
    lab = level3(value_col)
    n = F.count(F.lit(1))
    bad, mid, good = V.LEVEL3_LABELS[2], V.LEVEL3_LABELS[1], V.LEVEL3_LABELS[0]
    out = df.groupBy(*series_cols).agg(
        *[rounded(F.count_if(lab == x) * 100.0 / n, digits).alias(name)
          for x, name in ((bad, "bad_pct"), (mid, "moderate_pct"), (good, "good_pct"))])
    d = V.DOMINANT_LABELS
    return out.withColumn("dominant", F.when(F.col("bad_pct") > 50, d[0])
                          .when(F.col("moderate_pct") > 50, d[1]).otherwise(d[2]))


def peaks(df: DataFrame, *, ts: str = "date", value_col: str = "european_aqi",
          threshold: float = V.PEAK_THRESHOLD, top_n: int = V.PEAK_TOP_N,
          series_cols: Sequence[str] = ()) -> DataFrame:
    """Days whose maximum is above the threshold, highest first, top n.

    The limit is the feature (a top-n report). With series, top n per series.
    Day breaks ties so the result is deterministic.
    """
    daily = (df.filter(F.col(value_col) > threshold)
               .groupBy(*series_cols, F.date_format(ts, "yyyy-MM-dd").alias("date_str"))
               .agg(F.max(value_col).alias(value_col)))
    if not series_cols:
        return daily.orderBy(F.desc(value_col), "date_str").limit(top_n)
    from pyspark.sql import Window
    w = Window.partitionBy(*series_cols).orderBy(F.desc(value_col), "date_str")
    return daily.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= top_n) \
        .drop("_rk")


def daily_flag_max(df: DataFrame, *, ts: str = "date", flag_col: str = "anomaly",
                   series_cols: Sequence[str] = ()) -> DataFrame:
    """Whether any row of the day is flagged."""
    return (df.groupBy(*series_cols, F.date_format(ts, "yyyy-MM-dd").alias("date_str"))
              .agg(F.max(flag_col).alias(flag_col)))


def batch_bounds(df: DataFrame, *, ts: str = "date", series_cols: Sequence[str] = ()) -> DataFrame:
    """First and last time and row count of a batch."""
    return df.groupBy(*series_cols).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                        F.count(F.lit(1)).alias("n_rows"))

