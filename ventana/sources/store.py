"""Keyed store on Parquet: keep-first insert, high-water mark, freshness gate
(S7, S8, S12, S13; J3 is the anti-join inside S8).

The store is a day-partitioned Parquet table (see ``write_parquet_by_day``).
An insert only reads the days its batch touches (partition pruning on literal
bounds), so its cost follows the batch, not the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..session import has_file


def store_schema(value_cols: Sequence[str], series_cols: Sequence[str] = (),
                 ts: str = "date") -> T.StructType:
    """Series keys + unique timestamp + readings + load time."""
    fields = [T.StructField(s, T.LongType(), False) for s in series_cols]
    fields.append(T.StructField(ts, T.TimestampNTZType(), False))
    fields += [T.StructField(c, T.DoubleType(), True) for c in value_cols]
    fields.append(T.StructField("created_at", T.TimestampType(), True))
    return T.StructType(fields)


def keep_first(batch: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """Within a batch, the first row (by ``order_col``, nulls last) of each key wins; of rows
    with equal key and order, the one of the smallest hash does, so reruns choose alike.

    A ranked window that keeps rank 1: Spark keeps each task's first row of a key before the one
    exchange by key, so the copies of a hot key are gone before they could meet. Null keys count as one key.
    """
    cols = [f"`{c}`" for c in batch.columns]
    first = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(
        F.col(f"`{order_col}`").asc_nulls_last(), F.xxhash64(*[F.col(c) for c in cols]))
    rank = free_name(batch, "rank")
    return batch.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at ``path``, or None if nothing was written there yet.

    Only a missing folder, or one without a data file, is an empty store; a store
    that is there and cannot be read fails, so that stored keys are never added again.
    """
    return spark.read.parquet(path) if has_file(spark, path, ".parquet") else None


def new_rows(batch: DataFrame, target: DataFrame | None, key: Sequence[str], order_col: str,
             ts: str | None = None, day_col: str = "day") -> DataFrame:
    """S8 without the write: rows of the batch whose key is not stored yet.

    When ``ts`` is given, the target is first restricted to the batch's time
    range (two scalars; with a day-partitioned target this prunes partitions),
    then ``left_anti`` joined on the key. The existing row always wins.
    """
    firsts = keep_first(batch, key, order_col)
    if target is None:
        return firsts
    tgt = target
    if ts is not None:
        lo, hi = batch.agg(F.min(ts), F.max(ts)).first()
        if lo is None:
            return firsts.limit(0)
        if day_col in target.columns:      # partition column of the day layout: prune files
            tgt = tgt.filter(F.col(day_col).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))
        tgt = tgt.filter((F.col(ts) >= F.lit(lo)) & (F.col(ts) <= F.lit(hi)))
    return firsts.join(tgt.select(*key), list(key), "left_anti")


def insert_or_ignore(batch: DataFrame, target_path: str, key: Sequence[str], order_col: str,
                     ts: str = "date", day_col: str = "day") -> int:
    """Append the batch's new keys to the Parquet store; return the count.

    Idempotent: the same batch twice adds nothing the second time.
    """
    target = read_store(batch.sparkSession, target_path)
    rows = new_rows(batch, target, key, order_col, ts=ts, day_col=day_col)
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    rows = rows.withColumn(day_col, F.to_date(ts)).persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").partitionBy(day_col).parquet(target_path)
        return n
    finally:
        rows.unpersist()


def high_water(stored: DataFrame, series: DataFrame, *, key: str, ts: str = "date",
               end: str, backfill: str = V.BACKFILL_START) -> DataFrame:
    """Next start per series = last stored day + 1, else the back-fill
    date; series whose start is after ``end`` have nothing to fetch."""
    last = stored.groupBy(key).agg(F.max(ts).alias("last_ts"))
    start = F.coalesce(F.date_add(F.to_date("last_ts"), 1), F.to_date(F.lit(backfill)))
    return (series.select(key).distinct().join(last, key, "left")
                  .select(key, "last_ts", start.alias("start_date"),
                          F.to_date(F.lit(end)).alias("end_date"))
                  .filter(F.col("start_date") <= F.col("end_date")))


def due_series(log: DataFrame, series: DataFrame, *, key: str, last_col: str = "last_collect",
               now: str | None = None, days: int = V.FRESHNESS_DAYS) -> DataFrame:
    """Series due for collection: never collected, or last >= ``days`` ago."""
    now_c = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    j = series.select(key).distinct().join(log.select(key, last_col), key, "left")
    due = F.col(last_col).isNull() | \
        (F.col(last_col) <= now_c - F.expr(f"INTERVAL {int(days)} DAYS"))
    return j.withColumn("due", due)
