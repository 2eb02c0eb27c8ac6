"""Ordered per-series operators on streams: episodes and lags that go on across micro-batches.

Batch windows see a series whole and in order; a stream sees it in pieces, and rows may come late by as much as
the watermark allows. Every series therefore has a state of two parts:

* what the **settled** rows (up to the watermark, behind which no row can come any more) leave for later rows:
  the open run, or the last few values. Its size is fixed by the operator;
* the rows above the watermark, in order, waiting to be settled. Their number is bounded by the
  watermark's delay and the readings within it, not by the length of the stream.

In each micro-batch a series takes its new rows, settles what the watermark has passed and writes the results of settled
rows once, as *final*. What would follow from the waiting rows is written as *provisional* and replaced by the series'
next batch. A timer settles the waiting rows of series that get no more readings. Spark keeps the states of a group
of series together (``GROUPS`` by a hash), so that the calls of Python do not grow with the number of series. ``results`` reads both: final rows
and the provisional rows of each series' last batch, which together equal the batch operator over all rows
that were not late.

Each micro-batch writes a folder of its own and overwrites it, so a batch that is repeated after a failure
changes nothing. Rows at or below the watermark when they arrive are late and dropped; rows without a time or a value
are left out (as the batch operators do with nulls); equal times are ordered by ``tiebreak``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as V

#: Columns that a stream's output has besides keys and results.
STATUS, BATCH = "status", "batch_id"
FINAL, PROVISIONAL, SEEN = "final", "provisional", "seen"
#: Groups in which series are followed, and result rows handed on at once.
GROUPS = 4096
MOST_OUT = 20_000
#: Keys of series as text and back.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "ignoreNullFields": "false"}


class Episodes:
    """Runs above ``threshold`` of at least ``min_rows`` rows, numbered by changes of side."""

    schema = "episode long, debut string, fin string, duree long, aqi_max double, aqi_moy double"

    def __init__(self, threshold: float, min_rows: int):
        self.threshold, self.min_rows = threshold, min_rows

    def start(self) -> dict[str, Any]:
        return {"changes": 0, "bad": None, "n": 0}

    def step(self, at: dict, rows: list[tuple[int, int, float]]) -> tuple[list[dict], dict]:
        """Results of ordered rows (time in microseconds, tiebreak, value) and what they leave."""
        at, out = dict(at), []
        for t, _, v in rows:
            bad = v > self.threshold
            if bad != at["bad"]:
                out += self.tail(at)
                at = {"changes": at["changes"] + 1, "bad": bad, "n": 0, "sum": 0.0, "top": v, "first": t}
            at.update(n=at["n"] + 1, sum=at["sum"] + v, top=max(at["top"], v), last=t)
        return out, at

    def tail(self, at: dict) -> list[dict]:
        """The run that is still open."""
        if not at["bad"] or at["n"] < self.min_rows:
            return []
        day = {k: pd.Timestamp(at[k], unit="us").strftime("%Y-%m-%d") for k in ("first", "last")}
        return [{"episode": at["changes"], "debut": day["first"], "fin": day["last"], "duree": at["n"],
                 "aqi_max": at["top"], "aqi_moy": at["sum"] / at["n"]}]


class Lags:
    """Each row with the values ``offsets`` rows before it."""

    def __init__(self, offsets: Sequence[int], tiebreak: str):
        self.offsets = list(offsets)
        self.schema = f"{tiebreak} long, ts timestamp, value double, " + ", ".join(f"lag_{k} double" for k in offsets)
        self.tiebreak = tiebreak

    def start(self) -> dict[str, Any]:
        return {"last": []}

    def step(self, at: dict, rows: list[tuple[int, int, float]]) -> tuple[list[dict], dict]:
        last, out = list(at["last"]), []
        for t, k, v in rows:
            out.append({self.tiebreak: k, "ts": pd.Timestamp(t, unit="us"), "value": v,
                        **{f"lag_{o}": last[-o] if len(last) >= o else None for o in self.offsets}})
            last = [*last, v][-max(self.offsets):]
        return out, {"last": last}

    def tail(self, at: dict) -> list[dict]:
        return []


def _follow(operator, names: list[str]):
    """The state function of a group of series."""
    blank = {f.name: "" if isinstance(f.dataType, T.StringType) else pd.Timestamp(0) if isinstance(f.dataType, T.TimestampType)
             else 0 for f in T.StructType.fromDDL(operator.schema).fields}

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, waiting = (json.loads(x) for x in state.get) if state.exists else ({}, {})
        new: dict[str, list] = {}
        for f in frames:
            # NaN stands for a missing reading here as in the batch operators
            f = f[f["_value"].notna() & f["_time"].notna()]
            for k, *r in zip(f["_key"], f["_time"].astype("int64").tolist(), f["_tie"].astype("int64").tolist(),
                             f["_value"].tolist()):
                new.setdefault(k, []).append(tuple(r))
        settled = state.getCurrentWatermarkMs() * 1000
        out: list[dict] = []
        # series without new rows and without rows to settle stay as they are, and so do their provisional rows
        for k in [*new, *(k for k, rows in waiting.items() if k not in new and rows[0][0] <= settled)]:
            rows = sorted([*map(tuple, waiting.pop(k, [])), *new.get(k, [])])
            ready = [r for r in rows if r[0] <= settled]
            rest = rows[len(ready):]
            final, at = operator.step(carry.get(k) or operator.start(), ready)
            soon, then = operator.step(at, rest)
            carry[k] = at
            if rest:
                waiting[k] = rest
            # a row of its own tells that the series was here, so that older provisional rows no longer count
            out += [{**r, STATUS: s, "_key": k} for s, found in ((FINAL, final), (PROVISIONAL, [*soon, *operator.tail(then)]),
                                                                 (SEEN, [blank])) for r in found]
            if len(out) >= MOST_OUT:
                yield pd.DataFrame(out, columns=["_key", *names, STATUS])
                out = []
        state.update((json.dumps(carry), json.dumps(waiting)))
        if waiting:
            first = min(rows[-1][0] for rows in waiting.values())
            state.setTimeoutTimestamp(max(first // 1000, settled // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["_key", *names, STATUS])
    return follow


def stream_ordered(stream: DataFrame, operator, out_path: str, checkpoint: str, *, ts: str, value: str, tiebreak: str,
                   series_cols: Sequence[str], watermark: str, groups: int = GROUPS):
    """The started query that runs ``operator`` over every series of ``stream`` and writes its results below ``out_path``.

    Series are followed in ``groups`` groups by a hash, since Python is called once a group; the number holds for as long as
    the checkpoint is used."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    key = T.StructType([T.StructField(k, types[k]) for k in series_cols])
    own = T.StructType.fromDDL(operator.schema)
    result = T.StructType([T.StructField("_key", T.StringType()), *own.fields, T.StructField(STATUS, T.StringType())])
    rows = stream.withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(*series_cols), F.lit(groups)).alias("_group"), F.to_json(F.struct(*series_cols), KEY_TEXT).alias("_key"),
        ts, F.unix_micros(ts).alias("_time"), F.col(tiebreak).cast("long").alias("_tie"),
        F.col(value).cast("double").alias("_value"))
    followed = rows.groupBy("_group").applyInPandasWithState(
        _follow(operator, own.names), result, "carry string, waiting string", "append", GroupStateTimeout.EventTimeTimeout) \
        .withColumn("_key", F.from_json("_key", key, KEY_TEXT)).select("_key.*", *own.names, STATUS)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/{BATCH}={batch_id}")

    return (followed.writeStream.outputMode("append").foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_episodes(stream: DataFrame, out_path: str, checkpoint: str, *, ts: str, value: str, tiebreak: str,
                    series_cols: Sequence[str], watermark: str = "1 day", threshold: float = V.EPISODE_THRESHOLD,
                    min_rows: int = V.EPISODE_MIN_ROWS):
    """A26 on a stream."""
    return stream_ordered(stream, Episodes(threshold, min_rows), out_path, checkpoint, ts=ts, value=value,
                          tiebreak=tiebreak, series_cols=series_cols, watermark=watermark)


def stream_lags(stream: DataFrame, out_path: str, checkpoint: str, *, ts: str, value: str, tiebreak: str,
                series_cols: Sequence[str], offsets: Sequence[int], watermark: str = "1 day"):
    """W1 on a stream."""
    return stream_ordered(stream, Lags(offsets, tiebreak), out_path, checkpoint, ts=ts, value=value, tiebreak=tiebreak,
                          series_cols=series_cols, watermark=watermark)


def results(spark: SparkSession, out_path: str, series_cols: Sequence[str]) -> DataFrame:
    """Final rows, and the provisional rows of each series' last batch."""
    written = spark.read.parquet(out_path)
    last = F.max(BATCH).over(Window.partitionBy(*series_cols))
    return (written.filter(F.col(STATUS) != FINAL).withColumn("_last", last)
            .filter((F.col(BATCH) == F.col("_last")) & (F.col(STATUS) == PROVISIONAL)).drop("_last")
            .unionByName(written.filter(F.col(STATUS) == FINAL)).drop(BATCH))


def compact(spark: SparkSession, out_path: str, new_path: str, series_cols: Sequence[str]) -> None:
    """The results so far as one batch folder of a new output, without replaced rows: the last batch's number stays, so
    that the stream can go on into ``new_path`` from the same checkpoint."""
    written = spark.read.parquet(out_path)
    last = written.agg(F.max(BATCH)).first()[0]
    kept = results(spark, out_path, series_cols)
    marks = written.select(*series_cols).distinct().withColumn(STATUS, F.lit(SEEN))
    kept.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{new_path}/{BATCH}={last}")


__all__ = ["Episodes", "Lags", "stream_episodes", "stream_lags", "stream_ordered", "results", "compact"]
