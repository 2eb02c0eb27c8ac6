"""Ordered per-series operators.

Every window is ``Window.partitionBy(*series_cols).orderBy(ts)``; expressions
that share one spec are evaluated over one sort. Frames are counted in rows,
never in time (rule D15).

Scale note: these run on time grids (hourly or daily rows per series), whose
size per series is bounded by span / step, whatever the raw volume of the
series. For ordered windows over raw, unbounded series use ``blocked`` (same
results, windows split into time blocks with halos).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import rounded


def series_window(series_cols: Sequence[str], ts: str, *tiebreak: str) -> Window:
    return Window.partitionBy(*series_cols).orderBy(ts, *tiebreak)


def lag_exprs(w: Window, lags: dict[str, Sequence[int]], pattern: str = "{c}_lag_{k}") -> dict:
    """Named ``lag`` columns; ``lags`` maps column -> list of offsets."""
    return {pattern.format(c=c, k=k): F.lag(F.col(c), k).over(w)
            for c, ks in lags.items() for k in ks}


def add_lags(df: DataFrame, *, ts: str, lags: dict[str, Sequence[int]],
             series_cols: Sequence[str] = (), pattern: str = "{c}_lag_{k}") -> DataFrame:
    """Lags by rows of several columns over one sort."""
    return df.withColumns(lag_exprs(series_window(series_cols, ts), lags, pattern))


def add_lead(df: DataFrame, *, ts: str, col: str, out: str, n: int = 1,
             series_cols: Sequence[str] = ()) -> DataFrame:
    """Value ``n`` rows ahead (t+n target)."""
    return df.withColumn(out, F.lead(F.col(col), n).over(series_window(series_cols, ts)))


def first_diff(df: DataFrame, *, ts: str, col: str, out: str,
               series_cols: Sequence[str] = ()) -> DataFrame:
    """``x - lag(x, 1)``."""
    w = series_window(series_cols, ts)
    return df.withColumn(out, F.col(col) - F.lag(F.col(col), 1).over(w))


def rolling_mean_expr(w: Window, col: str, n: int, min_periods: int | None = None,
                      shift: int = 0) -> Column:
    """Mean over the ``n`` rows ending ``shift`` rows back; NULL unless at least
    ``min_periods`` of them hold a value (rule D13; default: all ``n``)."""
    need = n if min_periods is None else min_periods
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    x = F.col(col)
    return F.when(F.count(x).over(frame) >= need, F.avg(x).over(frame))


def add_rolling_mean(df: DataFrame, *, ts: str, col: str, out: str, n: int,
                     min_periods: int | None = None, shift: int = 0,
                     series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """W4 (full window), W5 (min 1), W6 (previous rows: ``shift=1``)."""
    w = series_window(series_cols, ts)
    return df.withColumn(out, rounded(rolling_mean_expr(w, col, n, min_periods, shift), digits))


def interpolate(df: DataFrame, *, ts: str, cols: Sequence[str],
                series_cols: Sequence[str] = ()) -> DataFrame:
    """Positional linear interpolation, forward direction (rule D12).

    Gaps between two known values are filled on a straight line by row
    position; leading nulls stay null; trailing nulls take the last value. The next
    known value is the last one seen from the series' end, as a frame that reaches to
    the end would be read anew for every row.
    """
    w = series_window(series_cols, ts)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*series_cols).orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    staged = df.withColumn("_pos", F.row_number().over(w))
    pos = F.col("_pos")
    out = {}
    for c in cols:
        x = F.col(c)
        pv = F.last(x, ignorenulls=True).over(back)
        pp = F.last(F.when(x.isNotNull(), pos), ignorenulls=True).over(back)
        nv = F.last(x, ignorenulls=True).over(ahead)
        np_ = F.last(F.when(x.isNotNull(), pos), ignorenulls=True).over(ahead)
        out[c] = (F.when(x.isNotNull(), x)
                   .when(pv.isNull(), F.lit(None).cast("double"))
                   .when(nv.isNull(), pv)
                   .otherwise(pv + (nv - pv) * (pos - pp) / (np_ - pp)))
    return staged.withColumns(out).drop("_pos")


def islands(df: DataFrame, *, ts: str, col: str, threshold: float,
            series_cols: Sequence[str] = (), flag: str = "bad", run: str = "episode",
            tiebreak: Sequence[str] = ()) -> DataFrame:
    """Run id that changes whenever ``col > threshold`` flips.

    Rows with a NULL value are removed first, so a time gap does not end a run;
    the first row starts a run (rule D14).
    """
    w = series_window(series_cols, ts, *tiebreak)
    base = df.filter(F.col(col).isNotNull()) \
        .withColumn(flag, (F.col(col) > threshold).cast("int"))
    change = F.coalesce(F.col(flag) != F.lag(flag, 1).over(w), F.lit(True)).cast("int")
    return base.withColumn("_chg", change) \
        .withColumn(run, F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .drop("_chg")


def episodes(df: DataFrame, *, ts: str = "date", col: str = "european_aqi",
             threshold: float = V.EPISODE_THRESHOLD, min_rows: int = V.EPISODE_MIN_ROWS,
             series_cols: Sequence[str] = (), digits: int | None = None,
             block_rows: int | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Runs above the threshold lasting at least ``min_rows`` rows:
    first and last day, rows, max and mean. ``block_rows`` numbers the runs
    with the blocked twin of ``islands`` (raw series too long for one task)."""
    if block_rows:
        from .blocked import islands as blocked_islands
        runs = blocked_islands(df, ts=ts, col=col, threshold=threshold, series_cols=series_cols,
                               block_rows=block_rows, tiebreak=tiebreak)
    else:
        runs = islands(df, ts=ts, col=col, threshold=threshold, series_cols=series_cols,
                       tiebreak=tiebreak)
    day = F.date_format(F.col(ts), "yyyy-MM-dd")
    return (runs.filter(F.col("bad") == 1)
                .groupBy(*series_cols, "episode")
                .agg(F.min_by(day, F.col(ts)).alias("debut"),
                     F.max_by(day, F.col(ts)).alias("fin"),
                     F.count(F.lit(1)).alias("duree"),
                     rounded(F.max(col), digits).alias("aqi_max"),
                     rounded(F.avg(col), digits).alias("aqi_moy"))
                .filter(F.col("duree") >= min_rows))


def last_n(df: DataFrame, *, ts: str, n: int, series_cols: Sequence[str] = ()) -> DataFrame:
    """L2: the latest ``n`` rows of each series (top-k per group, no global sort).

    Without series this is a plain top-n (``TakeOrderedAndProject``: n rows per
    task, then n overall), never a one-partition window.
    """
    if not series_cols:
        return df.orderBy(F.desc(ts)).limit(n)
    w = Window.partitionBy(*series_cols).orderBy(F.desc(ts))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def chrono_split(df: DataFrame, *, ts: str, train_share: float | None = 0.8,
                 test_share: float | None = None, series_cols: Sequence[str] = (),
                 out: str = "split", block_rows: int | None = None) -> DataFrame:
    """Ordered train/test split per series.

    ``train_share``: the first ``floor(share * n)`` rows train; ``test_share``:
    the last ``ceil(share * n)`` rows test (hold-out split without shuffling).
    ``block_rows`` numbers the rows with ``blocked.row_index`` (for long
    raw or keyless tables, which a plain window would hold in one task).
    """
    if block_rows:
        from .blocked import row_index
        staged = row_index(df, ts=ts, series_cols=series_cols, block_rows=block_rows)
        n, rn = F.col("_n"), F.col("_idx")
        n_train = n - F.ceil(n * F.lit(test_share)) if test_share is not None else \
            F.floor(n * F.lit(train_share))
        return staged.withColumn(out, F.when(rn <= n_train, "train").otherwise("test")) \
            .drop("_n", "_idx")
    w = series_window(series_cols, ts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series_cols))
    rn = F.row_number().over(w)
    if test_share is not None:
        n_train = n - F.ceil(n * F.lit(test_share))
    else:
        n_train = F.floor(n * F.lit(train_share))
    return df.withColumn(out, F.when(rn <= n_train, "train").otherwise("test"))


def first_last(df: DataFrame, *, ts: str, cols: Sequence[str], series_cols: Sequence[str] = (),
               tiebreak: str | None = None) -> DataFrame:
    """First and last value (by time) of each column per group.

    Hash aggregations of fixed-width values. With ``tiebreak`` (a number), rows of equal
    time are ordered by it: the first and last instants are found first, and only the rows
    at those instants are compared by the tiebreak.
    """
    if tiebreak is None:
        exprs = []
        for c in cols:
            exprs += [F.min_by(c, ts).alias(f"{c}_first"), F.max_by(c, ts).alias(f"{c}_last")]
        return df.groupBy(*series_cols).agg(*exprs)
    ends = df.groupBy(*series_cols).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    d, e = df.alias("d"), ends.alias("e")
    same = F.col(f"d.`{ts}`").between(F.col("e._lo"), F.col("e._hi"))
    for c in series_cols:
        same = same & F.col(f"d.`{c}`").eqNullSafe(F.col(f"e.`{c}`"))
    at_ends = d.join(e, same).filter((F.col(ts) == F.col("_lo")) | (F.col(ts) == F.col("_hi")))
    exprs = []
    for c in cols:
        exprs += [F.min_by(c, F.when(F.col(ts) == F.col("_lo"), F.col(tiebreak))).alias(f"{c}_first"),
                  F.max_by(c, F.when(F.col(ts) == F.col("_hi"), F.col(tiebreak))).alias(f"{c}_last")]
    return at_ends.groupBy(*[F.col(f"d.`{c}`").alias(c) for c in series_cols]).agg(*exprs)


def cumulative_sum(df: DataFrame, *, order_col: str, col: str, out: str,
                   series_cols: Sequence[str] = ()) -> DataFrame:
    """Running total in order."""
    w = Window.partitionBy(*series_cols).orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(col).over(w))


def rolling_daily(df: DataFrame, *, ts: str = "date", cols: Sequence[str], n: int = 24,
                  series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Rolling mean over ``n`` rows (min 1), then its mean per day."""
    w = series_window(series_cols, ts)
    rolled = df.select(*series_cols, F.date_format(ts, "yyyy-MM-dd").alias("date_str"),
                       *[rounded(rolling_mean_expr(w, c, n, 1), digits).alias(f"{c}_r")
                         for c in cols])
    return rolled.groupBy(*series_cols, "date_str").agg(
        *[rounded(F.avg(f"{c}_r"), digits).alias(f"{c}_r") for c in cols])


def history(daily: DataFrame, *, day_col: str = "day", col: str, n: int = 7,
            series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Latest ``n`` days of a daily table as (ISO day text, value)."""
    last = last_n(daily, ts=day_col, n=n, series_cols=series_cols)
    return last.select(*series_cols, F.date_format(day_col, "yyyy-MM-dd").alias("dates"),
                       rounded(F.col(col), digits).alias("values"))


def band(daily_max: DataFrame, daily_min: DataFrame, *, day_col: str = "day",
         value_col: str = "value", series_cols: Sequence[str] = ()) -> DataFrame:
    """Max curve then the min curve reversed, as one ordered polygon."""
    w_up = Window.partitionBy(*series_cols).orderBy(day_col)
    w_dn = Window.partitionBy(*series_cols).orderBy(F.desc(day_col))
    up = daily_max.select(*series_cols, day_col, value_col, F.lit("max").alias("bound"),
                          F.row_number().over(w_up).alias("seq"))
    dn = daily_min.select(*series_cols, day_col, value_col, F.lit("min").alias("bound"),
                          F.row_number().over(w_dn).alias("_r"))
    # the reversed half continues the sequence after the upper curve
    up_n = up.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("_n"))
    if series_cols:
        dn = dn.join(up_n, list(series_cols), "left")
    else:
        dn = dn.withColumn("_n", F.lit(up_n.select("_n").scalar()))
    dn = dn.select(*series_cols, day_col, value_col, "bound",
                   (F.coalesce("_n", F.lit(0)) + F.col("_r")).alias("seq"))
    return up.unionByName(dn)
