"""Structured Streaming ingest and daily means.

The reference polls an API on a timer and inserts new rows; here files landed
by a collector are read as a stream:

* T1 ``stream_insert``: each micro-batch goes through the batch keep-first
  insert (S8) inside ``foreachBatch``: duplicates inside a batch are combined
  by key, keys already stored are dropped by an anti-join against the store,
  so a replayed batch (after a failure) adds nothing -- exactly-once output on
  an append-only Parquet store. This needs no streaming state at all. The
  optional ``watermark`` adds ``dropDuplicatesWithinWatermark`` in front, which
  drops near-in-time copies before they reach the batch but keeps the first
  *arrival* rather than the smallest ``order_col``; leave it off when the
  keep-first order matters.
* T2 ``stream_daily``: ``withWatermark`` + ``window(ts, '1 day')`` means per
  series; rows later than the watermark are dropped (Spark checks late rows
  against the watermark reached at the end of the previous batch, so the cut
  is exact one batch later). Updates are written per batch to a change log
  (batch id kept); the latest version of each window is the result.
* T3 ``stream_alerts``: stateless label + filter.

Every stream takes its checkpoint folder from the caller: started again with the
same folder it resumes after the last committed batch; with a new one it reads its
source from the start (and T1 still adds nothing twice).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import level4
from ..session import checkpoint_dir, remove_at_exit
from ..sources.store import new_rows, read_store


def new_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders of a stream that is run once, removed at exit."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    remove_at_exit(spark, base)
    return os.path.join(base, "out"), os.path.join(base, "_checkpoint")


def as_glob(path: str) -> str:
    """A single-file path as a glob (the file stream source only infers a
    partition base for directories or globs)."""
    if any(ch in path for ch in "*?[{"):
        return path
    return path[:-1] + f"[{path[-1]}]"


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files: int | None = None, event_ts: str | None = None) -> DataFrame:
    """Parquet file stream with an explicit schema. ``event_ts`` (naive time)
    is turned into a session-zone TIMESTAMP, which watermarks require."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.parquet(as_glob(path))
    if event_ts:
        df = df.withColumn(event_ts, F.col(event_ts).cast("timestamp"))
    return df


def stream_insert(stream: DataFrame, target_path: str, checkpoint: str, *, key: Sequence[str],
                  order_col: str, ts: str, watermark: str | None = None,
                  day_col: str = "day"):
    """Keep-first incremental insert into a day-partitioned Parquet store.

    Returns the started query (``trigger(availableNow=True)``: drain what has
    landed, then stop).
    """
    src = stream
    if watermark:
        src = src.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)    # read for its time range and its rows
        try:
            rows = new_rows(held, read_store(held.sparkSession, target_path), key, order_col, ts=ts) \
                .withColumn(day_col, F.to_date(ts))
            rows.write.mode("append").partitionBy(day_col).parquet(target_path)
        finally:
            held.unpersist()

    return (src.writeStream.foreachBatch(write_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def stream_daily(stream: DataFrame, out_path: str, checkpoint: str, *, ts: str, value_col: str,
                 series_cols: Sequence[str] = (), watermark: str = "2 days"):
    """Daily windowed means per series with late-data cut-off.

    Event-time windows work on instants (``TIMESTAMP``) and day windows start at
    UTC midnight, so naive wall-clock readings give wall-clock days only in a
    UTC session (``build_session`` sets it; every batch operator here is
    zone-independent).
    """
    agg = (stream.withWatermark(ts, watermark)
                 .groupBy(F.window(F.col(ts), "1 day"), *series_cols)
                 .agg(F.avg(value_col).alias("mean"), F.count(F.lit(1)).alias("n")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*series_cols, F.col("window.start").alias("day_start"), "mean", "n",
                      F.lit(batch_id).alias("batch_id"))
              .write.mode("append").parquet(out_path))

    return (agg.writeStream.outputMode("update").foreachBatch(write_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def latest_versions(changes: DataFrame, key: Sequence[str], version: str = "batch_id") -> DataFrame:
    """Latest row per key of an update change log (top-1 per key)."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return changes.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1") \
        .drop("_rk", version)


def compact_versions(spark: SparkSession, out_path: str, new_path: str, key: Sequence[str], version: str = "batch_id") -> None:
    """The latest version of every window as the start of a new change log, so that readers need not go through
    all versions again; the stream goes on into ``new_path`` from its checkpoint."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    spark.read.parquet(out_path).withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk") \
        .write.mode("overwrite").parquet(new_path)


def alerts(df: DataFrame, *, value_col: str, keep: Sequence[str]) -> DataFrame:
    """Label each reading; keep the bad ones (stateless, stream or batch)."""
    lab = level4(value_col)
    return df.select(*keep, F.col(value_col), lab.alias("aqi_label")) \
        .filter(F.col("aqi_label").contains("Mauvais"))


def stream_alerts(stream: DataFrame, out_path: str, checkpoint: str, *, value_col: str,
                  keep: Sequence[str]):
    """T3 as a stream: append-only Parquet sink."""
    return (alerts(stream, value_col=value_col, keep=keep).writeStream.format("parquet")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_end(query) -> None:
    """Wait for an availableNow query and surface its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


__all__ = ["read_stream", "stream_insert", "stream_daily", "stream_alerts", "latest_versions", "compact_versions",
           "alerts", "run_to_end", "new_paths"]
