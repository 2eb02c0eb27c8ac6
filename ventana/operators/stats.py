"""Describe, missing values, data quality, correlations, distributions
(A12-A23, P15, P16, P25, P26).

Rule: one aggregation pass for all columns, then ``unpivot``/``stack`` into long
form -- never one job per column. Bin edges and fences come from one extra
aggregation pass (a few numbers, see ``bounds``), never from a join against
the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import level3, null_safe_corr, range_violation, rounded
from . import radix


def bounds(df: DataFrame, *exprs: Column) -> tuple:
    """A few numbers (bin edges, fences) from ONE aggregation pass.

    The plan that uses them then holds literals: a scalar subquery referenced
    in several expressions is executed once per reference, i.e. one extra scan
    each, so edges are fetched once instead (a handful of numbers, never rows).
    """
    row = df.agg(*exprs).first()
    return tuple(row) if row is not None else tuple(None for _ in exprs)


def _long(df: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "column") -> DataFrame:
    """One-row frame with ``{name}__{field}`` columns -> one row per name."""
    structs = [F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields])
               for n in names]
    return df.select(F.inline(F.array(*structs)))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) of any number of rows: columns q0, q1, ... per group,
    by radix selection (``radix``), which no task has to gather a group for."""
    found = radix.quantiles_long(df, [value_col], probs, group_cols, column="_column").drop("_column", "n")
    return found if group_cols else found.agg(*[F.max(c).alias(c) for c in found.columns])    # a row also without values


def _quartiles(x: Column, approx: bool, accuracy: int = 10000) -> Column:
    """Exact quartiles (linear interpolation; the aggregation buffer holds the
    group's distinct values) or the bounded-memory sketch for huge groups."""
    qs = [0.25, 0.5, 0.75]
    return F.percentile_approx(x, qs, accuracy) if approx else F.percentile(x, qs)


def describe(df: DataFrame, value_cols: Sequence[str], digits: int | None = None,
             approx: bool = False, distributed: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles (linear), max per column. ``distributed`` finds the
    quartiles of all columns by radix selection (raw rows) instead of one buffer per column."""
    if distributed:
        return _describe_raw(df, value_cols, digits)
    exprs = []
    for c in value_cols:
        x = F.col(c).cast("double")
        q = _quartiles(x, approx)
        exprs += [F.count(x).alias(f"{c}__count"),
                  rounded(F.avg(x), digits).alias(f"{c}__mean"),
                  rounded(F.stddev_samp(x), digits).alias(f"{c}__std"),
                  F.min(x).alias(f"{c}__min"),
                  rounded(q[0], digits).alias(f"{c}__p25"),
                  rounded(q[1], digits).alias(f"{c}__p50"),
                  rounded(q[2], digits).alias(f"{c}__p75"),
                  F.max(x).alias(f"{c}__max")]
    return _long(df.agg(*exprs), value_cols,
                 ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def _describe_raw(df: DataFrame, value_cols: Sequence[str], digits: int | None) -> DataFrame:
    parts = {c: F.col(c).cast("double") for c in value_cols}
    plain = _long(df.agg(*[e for c, x in parts.items() for e in (
        F.count(x).alias(f"{c}__count"), rounded(F.avg(x), digits).alias(f"{c}__mean"),
        rounded(F.stddev_samp(x), digits).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"))]),
        value_cols, ["count", "mean", "std", "min", "max"])
    quarters = radix.quantiles_long(df, value_cols, [0.25, 0.5, 0.75])
    return plain.join(quarters, "column", "left").select(
        "column", "count", "mean", "std", "min", rounded("q0", digits).alias("p25"), rounded("q1", digits).alias("p50"),
        rounded("q2", digits).alias("p75"), "max")


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (exact, or HLL sketch) and the
    row count (the table's shape).

    Exact: one grouping per column, each reading that column alone; what it
    shuffles are the column's distinct values per task, with their row counts
    (whose sum, nulls included, is the number of rows). ``approx=True`` keeps
    one fixed-size sketch per column in a single pass.
    """
    if approx:
        one = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"{c}__n_distinct") for c in cols],
                     F.count(F.lit(1)).alias("n_rows"))
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"{c}__n_distinct").alias("n_distinct"),
                     F.col("n_rows")) for c in cols])))
    parts = []
    for c in cols:
        each = df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        parts.append(each.agg(F.count("_v").alias("n_distinct"),
                              F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"))
                     .select(F.lit(c).alias("column"), "n_distinct", "n_rows"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def missing_report(df: DataFrame, cols: Sequence[str] | None = None,
                   digits: int | None = None) -> DataFrame:
    """Missing count and percent per column, most missing first."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"{c}__n_missing") for c in cols])
    long = one.select("_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n_missing").alias("n_missing"))
        for c in cols])))
    return (long.withColumn("pct_missing",
                            rounded(F.col("n_missing") * 100.0 / F.nullif(F.col("_n"), F.lit(0)),
                                    digits))
                .drop("_n").orderBy(F.desc("n_missing"), "column"))


def dq_report(df: DataFrame, *, ts: str = "date", cols: Sequence[str] | None = None,
              range_col: str = "pm2_5") -> DataFrame:
    """One-row data-quality report (null share map, rows, last update,
    range violations; ``anomalies_detected`` is always 0, as published)."""
    cols = list(cols or [c for c in df.columns if c != ts])
    n = F.count(F.lit(1))
    shares = F.create_map(*[x for c in cols for x in
                            (F.lit(c), F.count_if(F.col(c).isNull()) / F.nullif(n, F.lit(0)))])
    exprs = [shares.alias("missing_values_pct"), n.alias("total_rows"),
             # ISO text of the latest wall clock, labelled UTC (rule D3), as published
             F.concat(F.date_format(F.max(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
             .alias("last_update"),
             F.lit(0).alias("anomalies_detected")]
    if range_col in df.columns:
        exprs.append(F.count_if(range_violation(range_col)).alias("pm25_range_violation"))
    return df.agg(*exprs)


def linreg(df: DataFrame, *, x: str, y: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x over complete pairs (all rows)."""
    return df.groupBy(*series_cols).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_min"),
        F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_max"))


def fit_line(line: DataFrame, points: int = 50, series_cols: Sequence[str] = ()) -> DataFrame:
    """P25: the fitted line over an even grid of ``points`` x values."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    g = line.select(*series_cols, "slope", "intercept", "x_min", "x_max", i)
    xv = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    return g.select(*series_cols, "i", xv.alias("x"),
                    (F.col("intercept") + F.col("slope") * xv).alias("y_fit"))


def corr_matrix(df: DataFrame, cols: Sequence[str], listwise: bool = False,
                series_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Long-form correlation matrix (col_a, col_b, corr).

    Pairwise complete by default; ``listwise`` drops rows with any null first.
    n(n+1)/2 null-safe expressions in one aggregation; the mirror half is
    produced by the final ``inline`` and costs nothing.
    """
    src = df.dropna(subset=list(cols)) if listwise else df
    exprs, cells = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            name = f"c__{a}__{b}"
            exprs.append(rounded(null_safe_corr(a, b), digits).alias(name))
            cells.append((a, b, name))
            if a != b:
                cells.append((b, a, name))
    one = src.groupBy(*series_cols).agg(*exprs)
    return one.select(*series_cols, F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(n).alias("corr"))
        for a, b, n in cells])))


def corr_target(df: DataFrame, target: str, cols: Sequence[str],
                digits: int | None = None) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    one = df.agg(*[rounded(null_safe_corr(c, target), digits).alias(f"{c}__corr") for c in cols])
    return _long(one, cols, ["corr"]).orderBy(F.desc_nulls_last("corr"), "column")


def drop_sparse(df: DataFrame, cols: Sequence[str], max_null_share: float = 0.5) -> DataFrame:
    """Drop columns whose null share is above the limit.

    The output schema depends on the data, so the (one-row) share vector is
    fetched to the driver; it is one number per column.
    """
    n = F.count(F.lit(1))
    row = df.agg(*[(F.count_if(F.col(c).isNull()) / F.nullif(n, F.lit(0))).alias(c)
                   for c in cols]).first()
    drop = [c for c in cols if row is not None and row[c] is not None and row[c] > max_null_share]
    return df.drop(*drop)


def skip_all_null(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that hold at least one value (one count per column)."""
    row = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if row is not None and row[c] > 0]


def range_violations(df: DataFrame, cols: Sequence[str], lo: float = V.PM25_RANGE[0],
                     hi: float = V.PM25_RANGE[1]) -> DataFrame:
    """Rows outside [lo, hi] per column, long form."""
    one = df.agg(*[F.count_if(range_violation(c, lo, hi)).alias(f"{c}__n_violations")
                   for c in cols])
    return _long(one, cols, ["n_violations"])


def _bin(x: Column, lo: Column, width: Column, bins: int) -> Column:
    """Equal-width bin with the maximum clamped into the last bin."""
    b = F.floor((x - lo) / F.nullif(width.cast("double"), F.lit(0.0))).cast("int")
    return F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1))


def histogram(df: DataFrame, value_col: str, bins: int = 40,
              series_cols: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram (bin, lower edge, upper edge, count).

    The global range comes from one aggregation pass; the data is then binned
    in the scan and only (bin, count) partials shuffle.
    """
    x = F.col(value_col).cast("double")
    lo, hi = bounds(df, F.min(x), F.max(x))
    if lo is None:
        # nothing to bin: the same columns and types (a plan over no rows, keys as they are)
        return df.limit(0).groupBy(*series_cols, F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n")) \
            .filter("n > 0").select(*series_cols, "bin", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "n")
    width = (hi - lo) / float(bins)
    b = _bin(x, F.lit(lo), F.lit(width), bins)
    return (df.filter(x.isNotNull())
              .groupBy(*series_cols, b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select(*series_cols, "bin",
                      (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n"))


#: Multiples of a power of ten that a drawn bin may be wide.
NICE_STEPS = (2.0, 5.0, 10.0)


def nice_width(span: float, max_bins: int) -> float:
    """The narrowest of 1, 2 or 5 times a power of ten that is wider than ``span / max_bins``; 1 without a span."""
    if not span > 0:
        return 1.0
    base = 10.0 ** math.floor(math.log10(span / max_bins))
    return base * next(s for s in NICE_STEPS if s > span / max_bins / base or s == NICE_STEPS[-1])


def nice_bins(df: DataFrame, value_col: str, max_bins: int) -> tuple[float, float] | None:
    """(start, width) of a histogram as it is drawn; None without values.

    The start is the multiple of the width below the least value. Whole numbers get bins around them (starts
    at .5); other values, where they lie on the edges of bins rather than in their middles, get a start
    moved by half a bin. Two aggregations of a few counts decide it.
    """
    x = F.col(value_col).cast("double")
    lo, hi, n, whole = bounds(df, F.min(x), F.max(x), F.count(x), F.count_if(x % 1 == 0))
    if lo is None:
        return None
    width = nice_width(hi - lo, max_bins)
    start = math.ceil((lo * 1.0001 - hi * 0.0001) / width) * width - width
    if whole == n:
        if width < 1:
            return lo - width / 2, width
        start -= 0.5
        return (start + width if start + width < lo else start), width

    def near_edge(v):
        return (1 + (v - start) * 100 / width) % 100 < 2
    edges, middles = bounds(df, F.count_if(near_edge(x)), F.count_if(near_edge(x + width / 2)))
    if middles < n * 0.1 and (edges > n * 0.3 or near_edge(lo) or near_edge(hi)):
        start += width / 2 if start + width / 2 < lo else -width / 2
    return start, width


def nice_histogram(df: DataFrame, value_col: str, max_bins: int = 40, series_cols: Sequence[str] = ()) -> DataFrame:
    """A20 with the bins that the dashboards draw (``nice_bins`` over all rows): bin, lower and upper edge, count;
    a value on an edge belongs to the bin above it, empty bins have no row."""
    found = nice_bins(df, value_col, max_bins)
    start, width = found or (0.0, 1.0)
    x = F.col(value_col).cast("double")
    at = F.floor((x - F.lit(start)) / F.lit(width) + 1e-9).cast("int")
    return (df.filter(x.isNotNull()).groupBy(*series_cols, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select(*series_cols, "bin", (F.lit(start) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(start) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n"))


def box_stats(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
              whisker: float = 1.5, approx: bool = False, distributed: bool = False) -> DataFrame:
    """Quartiles, median, mean, sd, whiskers (extreme values inside the
    1.5 IQR fences), outlier count, per group.

    Two passes: the per-group statistics (one row per group), then one join of
    the rows with them (a small side AQE can broadcast after measuring it) and
    one aggregation that carries the statistics through to the output. Over all
    rows (no group), and with ``distributed`` for groups of raw rows, the quartiles are those of
    ``exact_quantiles``, which no single task gathers. With ``distributed`` the statistics are
    written first and the rows are not the outer side of their join, so that the statistics can be
    broadcast and rows are added up where they are read, however few groups they have.
    """
    x = F.col(value_col)
    g = list(group_cols)
    if g and distributed:
        parts = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], g).alias("p")
        m = df.groupBy(*g).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")).alias("m")
        same = F.lit(True)
        for c in g:
            same = same & F.col(f"m.`{c}`").eqNullSafe(F.col(f"p.`{c}`"))
        q = m.join(parts, same, "left").select(*[F.col(f"m.`{c}`").alias(c) for c in g], F.col("q0").alias("q1"),
                                               F.col("p.q1").alias("median"), F.col("q2").alias("q3"), "mean", "sd", "n")
    elif g or approx:
        q = (df.groupBy(*g)
               .agg(_quartiles(x.cast("double"), approx).alias("_q"),
                    F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n"))
               .select(*g, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                       F.col("_q")[2].alias("q3"), "mean", "sd", "n"))
    else:
        parts = exact_quantiles(df, value_col, [0.25, 0.5, 0.75]).first() or (None, None, None)
        q = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")) \
            .select(*[F.lit(v).cast("double").alias(c) for c, v in zip(("q1", "median", "q3"), parts)],
                    "mean", "sd", "n")
    iqr = F.col("q3") - F.col("q1")
    rows = df.filter(x.isNotNull()).select(*g, x.alias("_x"))
    stats = ["q1", "median", "q3", "mean", "sd", "n"]
    if g and distributed:
        told = radix.stored(q)
        joined, carried = rows.join(told, g), []
    elif g:
        joined = q.join(rows, g, "left")
        carried = [F.first(c).alias(c) for c in stats]
    else:
        vals = bounds(q, *[F.first(c) for c in stats])
        joined = rows.select("_x", *[F.lit(v).alias(c) for c, v in zip(stats, vals)])
        carried = [F.lit(v).cast("bigint" if c == "n" else "double").alias(c)
                   for c, v in zip(stats, vals)]
    lo = F.col("q1") - whisker * iqr
    hi = F.col("q3") + whisker * iqr
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    out = joined.groupBy(*g).agg(
        *carried,
        F.min(F.when(inside, F.col("_x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_x"))).alias("upper_whisker"),
        F.count_if(F.col("_x").isNotNull() & ~inside).alias("n_outliers"))
    if g and distributed:
        # groups without values, and null groups, keep their row
        out = told.join(out, g, "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
    return out


def density2d(df: DataFrame, x: str, y: str, bins: int = 20,
              level_from: str | None = "pm2_5") -> DataFrame:
    """2-D equal-width bin counts of (x, y), split by PM2.5 level."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    xlo, xhi, ylo, yhi = bounds(df, F.min(X), F.max(X), F.min(Y), F.max(Y))
    xw = (xhi - xlo) / float(bins) if xlo is not None else None
    yw = (yhi - ylo) / float(bins) if ylo is not None else None
    bx = _bin(X, F.lit(xlo), F.lit(xw), bins)
    by = _bin(Y, F.lit(ylo), F.lit(yw), bins)
    keys = [level3(level_from).alias("level")] if level_from else []
    return (df.filter(X.isNotNull() & Y.isNotNull())
              .groupBy(*keys, bx.alias("bx"), by.alias("by"))
              .agg(F.count(F.lit(1)).alias("n")))


def wind_rose(df: DataFrame, direction: str, speed: str) -> DataFrame:
    """Counts per 16 sectors x 5 speed bins, all 80 cells kept.

    Sector = floor(pmod(dir, 360) / 22.5); speeds outside [0, 50) are dropped
    (the last bin is labelled '>20' but stops at 50). The 80-cell grid is a
    fixed-size frame; the data side is one aggregation.
    """
    edges = V.WIND_SPEED_EDGES
    size = 360.0 / V.WIND_SECTORS
    s = F.col(speed)
    sbin = None
    for i in range(len(edges) - 1):
        cond = (s >= edges[i]) & (s < edges[i + 1])
        sbin = F.when(cond, i) if sbin is None else sbin.when(cond, i)
    sector = (F.floor(F.pmod(F.col(direction), F.lit(360.0)) / size).cast("int")
              % V.WIND_SECTORS)
    counts = (df.filter(F.col(direction).isNotNull() & s.isNotNull())
                .select(sector.alias("sector"), sbin.alias("speed_bin"))
                .filter(F.col("speed_bin").isNotNull())
                .groupBy("sector", "speed_bin").agg(F.count(F.lit(1)).alias("n")))
    nb = len(edges) - 1
    labels = F.array(*[F.lit(v) for v in V.WIND_SPEED_LABELS])
    grid = (df.sparkSession.range(V.WIND_SECTORS * nb)
              .select((F.col("id") / nb).cast("int").alias("sector"),
                      (F.col("id") % nb).cast("int").alias("speed_bin")))
    return (grid.join(counts, ["sector", "speed_bin"], "left")
                .select("sector", (F.col("sector") * F.lit(size)).cast("int").alias("sector_deg"),
                        "speed_bin", F.element_at(labels, F.col("speed_bin") + 1).alias("speed_label"),
                        F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def autocorr(df: DataFrame, *, ts: str, value_col: str, max_lag: int = 24,
             series_cols: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Autocorrelation at lags 1..max_lag over complete pairs.

    All lags come from one sort per series (same window spec), then one
    aggregation of null-safe correlations, then long form. ``block_rows``
    computes the lags in blocks (``blocked.bounded``) for raw series too
    long for one task.
    """
    x = F.col(value_col)

    def build(w):
        return {f"_l{k}": F.lag(x, k).over(w) for k in range(1, max_lag + 1)}

    if block_rows:
        from .blocked import bounded
        lagged = bounded(df.select(*series_cols, ts, x.alias("_x"), x), ts=ts, build=build,
                         back=max_lag, series_cols=series_cols, block_rows=block_rows)
    else:
        w = Window.partitionBy(*series_cols).orderBy(ts)
        lagged = df.select(*series_cols, x.alias("_x"), *[c.alias(n) for n, c in build(w).items()])
    one = lagged.groupBy(*series_cols).agg(
        *[null_safe_corr("_x", f"_l{k}").alias(f"a{k}") for k in range(1, max_lag + 1)])
    return one.select(*series_cols, F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf"))
        for k in range(1, max_lag + 1)])))
