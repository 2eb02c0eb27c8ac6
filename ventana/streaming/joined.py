"""Two streams joined by series and time.

Both sides carry a watermark and the join is on (series, time), so Spark keeps a row only until the other side's
watermark has passed its time: the state holds the rows of the watermarks' delay, however long the streams run.

Defined cases, as in the batch join: a row joins every row of the other side with its series and time; null keys join
nothing; joined rows that lack a required value are dropped. A row that arrives at or below its side's watermark is late and
dropped (``numRowsDroppedByWatermark`` of the query's progress counts them). With ``unmatched`` a full outer
join is run instead: rows whose partner cannot come any more (the watermark has passed them) are written there with the
side they came from, and rows that still wait at the end of a run wait on in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = "batch_id"


def stream_merge(left: DataFrame, right: DataFrame, out_path: str, checkpoint: str, *, on: Sequence[str], ts: str,
                 required: Sequence[str] = ("pm10", "pm2_5", "temperature_2m"), watermark: str = "1 day",
                 unmatched: str | None = None):
    """J1 on streams: the started query; ``on`` holds the series and ``ts``. Every micro-batch overwrites a folder of its own."""
    if ts not in on:
        raise ValueError("the time must be one of the join columns, or the state would grow without bound")
    extra = [c for c in right.columns if c in left.columns and c not in on]
    if extra:
        raise ValueError(f"both sides have the columns {extra}")
    l = left.withWatermark(ts, watermark).select(*[F.col(f"`{c}`") for c in left.columns], F.lit(True).alias("_left"))
    r = right.withWatermark(ts, watermark).select(
        *[F.col(f"`{c}`").alias(f"_on_{c}" if c in on else c) for c in right.columns], F.lit(True).alias("_right"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"`{c}`") == F.col(f"`_on_{c}`"))
    joined = l.join(r, same, "full_outer" if unmatched else "inner")
    kept = [c for c in required if c in left.columns or c in right.columns]
    values = [c for c in [*left.columns, *right.columns] if c not in on]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK) if unmatched else batch
        try:
            keys = [F.coalesce(F.col(f"`{c}`"), F.col(f"`_on_{c}`")).alias(c) for c in on]
            values_ = [F.col(f"`{c}`") for c in dict.fromkeys(values)]
            both = held.filter("_left and _right").select(*keys, *values_)
            both.dropna(subset=kept).write.mode("overwrite").parquet(f"{out_path}/{BATCH}={batch_id}")
            if unmatched:
                alone = held.filter("_left is null or _right is null").select(
                    *keys, *values_, F.when(F.col("_left"), "left").otherwise("right").alias("side"))
                alone.write.mode("overwrite").parquet(f"{unmatched}/{BATCH}={batch_id}")
        finally:
            if unmatched:
                held.unpersist()

    return (joined.writeStream.outputMode("append").foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


__all__ = ["stream_merge"]
