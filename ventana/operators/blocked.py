"""Ordered windows over raw, unbounded series, split into blocks of bounded size.

``Window.partitionBy(series).orderBy(ts)`` puts a whole series in one task; for
a station that holds a third of all rows that task is the job. Here the rows are
range-partitioned by (series, time, tiebreak) into blocks of about ``block_rows``
rows at most and written once (so that block numbers cannot change between the
steps that use them); the window runs per (series, block), and only the rows near
block edges, or one summary row per block, cross blocks. A busy hour is cut like
any other stretch: blocks follow row counts, not the clock, and rows of equal time
are spread by the tiebreak. Results equal the plain window (tests check this).

* ``bounded``: frames that reach at most ``back`` rows back and ``ahead``
  rows ahead (lag, lead, rolling means, shifted frames). Rows within
  ``back + ahead`` of a block edge form a thin "edge set" (at most that many
  rows per block edge); the edge rows that need other blocks are recomputed
  over the edge set ordered by (block, ts). The edge set holds all of their
  neighbours, consecutive, so the frame is exact.
* ``interpolate`` and ``islands``: unbounded frames. A per-block summary
  (row count, first/last known value and position, first/last flag, change
  count) is scanned per series -- one row per block -- and the carries are joined back on (series, block), the key the
  rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows a block should stay under.
BLOCK_ROWS = 1_000_000


def cut(df: DataFrame, ts: str, series: Sequence[str], block_rows: int,
        tiebreak: Sequence[str]) -> DataFrame:
    """Rows with their block number ``_blk``, in the order of (series, time, tiebreak).

    Range bounds come from a sample, so twice as many blocks as needed are cut;
    the largest then stays under ``block_rows``.
    """
    spark = df.sparkSession
    blocks = max(1, -(-2 * df.count() // block_rows))
    path = scratch_path(spark, "blocks")
    df.repartitionByRange(blocks, *series, ts, *tiebreak) \
        .withColumn("_blk", F.spark_partition_id().cast("long")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _staged(df: DataFrame, ts: str, series: Sequence[str], block_rows: int, tiebreak):
    wa = Window.partitionBy(*series, "_blk").orderBy(ts, *tiebreak)
    staged = cut(df, ts, series, block_rows, tiebreak) \
        .withColumns({"_rn": F.row_number().over(wa),
                      "_cnt": F.count(F.lit(1)).over(Window.partitionBy(*series, "_blk"))})
    return staged, wa


def bounded(df: DataFrame, *, ts: str, build: Callable[[Window], dict], back: int = 0,
            ahead: int = 0, series_cols: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
            tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add the columns ``build(window)`` returns, for frames within
    ``[-back, +ahead]`` rows, computed per block with edge repair."""
    series = list(series_cols)
    staged, wa = _staged(df, ts, series, block_rows, tiebreak)
    reach = back + ahead
    needs_edge = (F.col("_rn") <= back) | (F.col("_rn") > F.col("_cnt") - ahead)
    inner = staged.withColumns(build(wa)).filter(~needs_edge)
    wb = Window.partitionBy(*series).orderBy("_blk", ts, *tiebreak)
    edge_set = staged.filter((F.col("_rn") <= reach) | (F.col("_rn") > F.col("_cnt") - reach))
    edge = edge_set.withColumns(build(wb)).filter(needs_edge)
    return inner.unionByName(edge).drop("_blk", "_rn", "_cnt")


def interpolate(df: DataFrame, *, ts: str, cols: Sequence[str], series_cols: Sequence[str] = (),
                block_rows: int = BLOCK_ROWS, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Blocked twin of ``windows.interpolate`` (positional, forward only)."""
    series = list(series_cols)
    staged, wa = _staged(df, ts, series, block_rows, tiebreak)
    rn = F.col("_rn")
    aggs = [F.count(F.lit(1)).alias("_bn")]
    for c in cols:
        known = F.when(F.col(c).isNotNull(), rn)
        aggs += [F.max(known).alias(f"_lp_{c}"), F.max_by(F.col(c), known).alias(f"_lv_{c}"),
                 F.min(known).alias(f"_fp_{c}"), F.min_by(F.col(c), known).alias(f"_fv_{c}")]
    summ = staged.groupBy(*series, "_blk").agg(*aggs)
    wbk = Window.partitionBy(*series).orderBy("_blk")
    before = wbk.rowsBetween(Window.unboundedPreceding, -1)
    after = wbk.rowsBetween(1, Window.unboundedFollowing)
    carry = {"_off": F.coalesce(F.sum("_bn").over(before), F.lit(0))}
    summ = summ.withColumns(carry)
    carries = {}
    for c in cols:
        gl = F.col("_off") + F.col(f"_lp_{c}")
        gf = F.col("_off") + F.col(f"_fp_{c}")
        carries[f"_cpv_{c}"] = F.last(F.col(f"_lv_{c}"), ignorenulls=True).over(before)
        carries[f"_cpp_{c}"] = F.last(F.when(F.col(f"_lv_{c}").isNotNull(), gl), ignorenulls=True).over(before)
        carries[f"_cnv_{c}"] = F.first(F.col(f"_fv_{c}"), ignorenulls=True).over(after)
        carries[f"_cnp_{c}"] = F.first(F.when(F.col(f"_fv_{c}").isNotNull(), gf), ignorenulls=True).over(after)
    summ = summ.withColumns(carries).select(*series, "_blk", "_off", *carries.keys())
    rows = staged.join(summ, [*series, "_blk"], "left")
    back = wa.rowsBetween(Window.unboundedPreceding, 0)
    fwd = wa.rowsBetween(0, Window.unboundedFollowing)
    pos = F.col("_off") + rn
    out = {}
    for c in cols:
        x = F.col(c)
        known_pos = F.when(x.isNotNull(), pos)
        pv = F.coalesce(F.last(x, ignorenulls=True).over(back), F.col(f"_cpv_{c}"))
        pp = F.coalesce(F.last(known_pos, ignorenulls=True).over(back), F.col(f"_cpp_{c}"))
        nv = F.coalesce(F.first(x, ignorenulls=True).over(fwd), F.col(f"_cnv_{c}"))
        np_ = F.coalesce(F.first(known_pos, ignorenulls=True).over(fwd), F.col(f"_cnp_{c}"))
        out[c] = (F.when(x.isNotNull(), x)
                   .when(pv.isNull(), F.lit(None).cast("double"))
                   .when(nv.isNull(), pv)
                   .otherwise(pv + (nv - pv) * (pos - pp) / (np_ - pp)))
    helpers = ["_blk", "_rn", "_cnt", "_off", *carries.keys()]
    return rows.withColumns(out).drop(*helpers)


def islands(df: DataFrame, *, ts: str, col: str, threshold: float,
            series_cols: Sequence[str] = (), flag: str = "bad", run: str = "episode",
            block_rows: int = BLOCK_ROWS, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Blocked twin of ``windows.islands`` (same run ids)."""
    series = list(series_cols)
    base = df.filter(F.col(col).isNotNull()) \
        .withColumn(flag, (F.col(col) > threshold).cast("int"))
    staged, wa = _staged(base, ts, series, block_rows, tiebreak)
    f = F.col(flag)
    local_chg = F.coalesce((f != F.lag(f, 1).over(wa)).cast("int"), F.lit(0))
    staged = staged.withColumn("_lc", local_chg)
    summ = staged.groupBy(*series, "_blk").agg(
        F.min_by(f, F.col("_rn")).alias("_ff"), F.max_by(f, F.col("_rn")).alias("_lf"),
        F.sum("_lc").alias("_inner"))
    wbk = Window.partitionBy(*series).orderBy("_blk")
    first_chg = F.coalesce((F.col("_ff") != F.lag("_lf", 1).over(wbk)).cast("int"), F.lit(1))
    summ = summ.withColumn("_fc", first_chg) \
        .withColumn("_bc", F.col("_fc") + F.col("_inner"))
    summ = summ.withColumn("_roff", F.coalesce(
        F.sum("_bc").over(wbk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .select(*series, "_blk", "_fc", "_roff")
    rows = staged.join(summ, [*series, "_blk"], "left")
    chg = F.when(F.col("_rn") == 1, F.col("_fc")).otherwise(F.col("_lc"))
    within = F.sum(chg).over(wa.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(run, (F.col("_roff") + within).cast("bigint")) \
        .drop("_blk", "_rn", "_cnt", "_lc", "_fc", "_roff")


def row_index(df: DataFrame, *, ts: str, series_cols: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
              tiebreak: Sequence[str] = (), idx: str = "_idx", total: str = "_n") -> DataFrame:
    """1-based position of each row in its series (and the series row count)
    without a one-partition window: rank inside (series, block), plus the rows
    of all earlier blocks from a per-block count scanned per series."""
    series = list(series_cols)
    staged, _ = _staged(df, ts, series, block_rows, tiebreak)
    summ = staged.groupBy(*series, "_blk").agg(F.count(F.lit(1)).alias("_bn"))
    wbk = Window.partitionBy(*series).orderBy("_blk")
    summ = summ.select(*series, "_blk",
                       F.coalesce(F.sum("_bn").over(wbk.rowsBetween(Window.unboundedPreceding, -1)),
                                  F.lit(0)).alias("_off"),
                       F.sum("_bn").over(Window.partitionBy(*series)).alias(total))
    out = staged.join(summ, [*series, "_blk"], "left")
    return out.withColumn(idx, F.col("_off") + F.col("_rn")).drop("_blk", "_rn", "_cnt", "_off")
