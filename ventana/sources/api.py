"""Array-shaped API responses to rows.

A response holds a time axis as (start, end exclusive, step) in epoch seconds,
a UTC offset, and one array per variable. Rows come from zipping the arrays
and numbering their positions -- a generator in the scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_response(df: DataFrame, *, variables: Sequence[str], start: str = "start",
                    end: str = "end", step: str = "step_s", offset: str = "utc_offset_s",
                    keep: Sequence[str] = (), ts: str = "date") -> DataFrame:
    """One row per time step: ts = start + offset + pos * step (rule D3:
    the local clock is labelled UTC, the offset is added once, no zone change).

    The time axis (end exclusive) and every array must have the same length:
    a response whose lengths differ, or that lacks an array, fails the job
    instead of losing or inventing values.
    """
    n_steps = F.ceil((F.col(end) - F.col(start)) / F.col(step))
    fits = F.lit(True)
    for v in variables:
        fits = fits & F.coalesce(F.size(v) == n_steps, F.lit(False))
    lengths = F.concat_ws(", ", *[F.concat(F.lit(f"{v}: "), F.coalesce(F.size(v).cast("string"), F.lit("none")))
                                  for v in variables])
    message = F.concat(F.lit("array response: the time axis has "), F.coalesce(n_steps.cast("string"), F.lit("no")),
                       F.lit(" steps, the arrays have "), lengths)
    zipped = F.when(fits, F.arrays_zip(*[F.col(v).alias(v) for v in variables])) \
        .otherwise(F.raise_error(message))
    exploded = df.select(*keep, start, end, step, offset,
                         F.posexplode(zipped).alias("_pos", "_v"))
    secs = F.col(start) + F.col(offset) + F.col("_pos") * F.col(step)
    return (exploded.select(*keep, F.timestamp_seconds(secs).cast("timestamp_ntz").alias(ts),
                            F.col("_pos").alias("pos"),
                            *[F.col(f"_v.{v}").cast("double").alias(v) for v in variables]))
