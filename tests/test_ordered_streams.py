"""Streams with order: equal to the batch operators over several batches, restarts and late rows."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ventana.operators import joins as J
from ventana.operators import windows as W
from ventana.session import checkpoint_dir
from ventana.streaming import ingest, joined, ordered

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "s string, id long, ts timestamp_ntz, v double"


def _tmp(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _land(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _rows(seed=1, n=300):
    draw = random.Random(seed)
    out, level = [], {"a": 50.0, "b": 50.0, "c": 90.0}
    for i in range(n):
        s = draw.choice("abc")
        if draw.random() < 0.1:
            level[s] = draw.choice([50.0, 90.0])
        out.append((s, i, T0 + dt.timedelta(minutes=30 * (i // 2)), draw.choice([None, float("nan")]) if draw.random() < 0.05
                    else level[s] + draw.random()))
    return out


def _episodes(spark, land, out, ck, watermark):
    s = ingest.read_stream(spark, land, spark.createDataFrame([], SCHEMA).schema, event_ts="ts")
    q = ordered.stream_episodes(s, out, ck, ts="ts", value="v", tiebreak="id", series_cols=["s"], watermark=watermark,
                                threshold=60.0, min_rows=3)
    ingest.run_to_end(q)


def _batch_episodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = W.episodes(df, ts="ts", col="v", threshold=60.0, min_rows=3, series_cols=["s"], tiebreak=["id"]).collect()
    return sorted((r.s, r.episode, r.debut, r.fin, r.duree, round(r.aqi_max, 9), round(r.aqi_moy, 9)) for r in got)


def _stream_result(spark, out):
    got = ordered.results(spark, out, ["s"]).collect()
    return sorted((r.s, r.episode, r.debut, r.fin, r.duree, round(r.aqi_max, 9), round(r.aqi_moy, 9)) for r in got)


@pytest.mark.parametrize("watermark,shuffled", [("0 seconds", False), ("3 hours", False), ("100 days", True)])
def test_episodes_equal_the_batch_over_restarts(spark, watermark, shuffled):
    """Rows of a part arrive in any order; parts follow each other, or (within the delay) not."""
    rows = _rows()
    land, out, ck = (_tmp(spark, n) for n in ("land", "out", "ck"))
    parts = [rows[:90], rows[90:200], rows[200:]]
    if shuffled:
        random.Random(3).shuffle(rows)
        parts = [rows[:90], rows[90:200], rows[200:]]
    for i, part in enumerate(parts):
        _land(spark, land, random.Random(i).sample(part, len(part)))
        _episodes(spark, land, out, ck, watermark)
        seen = [r for p in parts[:i + 1] for r in p]
        if watermark != "0 seconds" or i == 0:
            assert _stream_result(spark, out) == _batch_episodes(spark, seen)
    assert len(os.listdir(out)) >= 3
    if watermark == "3 hours":
        status = {r.status for r in ordered.results(spark, out, ["s"]).collect()}
        assert status == {"final", "provisional"}
        new = _tmp(spark, "compact")
        ordered.compact(spark, out, new, ["s"])
        assert _stream_result(spark, new) == _stream_result(spark, out)
        more = [("a", 1000 + i, T0 + dt.timedelta(days=20, minutes=i), 90.0) for i in range(5)]
        _land(spark, land, more)
        _episodes(spark, land, new, ck, watermark)
        assert _stream_result(spark, new) == _batch_episodes(spark, rows + more)


def test_late_rows_are_dropped_and_quiet_series_settle(spark):
    land, out, ck = (_tmp(spark, n) for n in ("land", "out", "ck"))
    first = [("a", i, T0 + dt.timedelta(hours=i), 90.0) for i in range(4)]
    _land(spark, land, first)
    _episodes(spark, land, out, ck, "1 hour")
    other = [("b", 10 + i, T0 + dt.timedelta(days=3, hours=i), 90.0) for i in range(2)]
    _land(spark, land, other)
    _episodes(spark, land, out, ck, "1 hour")
    # the timer settled the rows of the series that got nothing new; its run stays open
    rows = spark.read.parquet(out).filter("s = 'a'")
    assert rows.agg(F.max("batch_id")).first()[0] > rows.agg(F.min("batch_id")).first()[0]
    late = [("a", 99, T0 + dt.timedelta(hours=1, minutes=30), 10.0)]
    _land(spark, land, late)
    _episodes(spark, land, out, ck, "1 hour")
    assert _stream_result(spark, out) == _batch_episodes(spark, first + other)
    end = [("a", 100, T0 + dt.timedelta(days=5), 10.0), ("a", 101, T0 + dt.timedelta(days=9), 10.0)]
    _land(spark, land, end)
    _episodes(spark, land, out, ck, "1 hour")
    assert _stream_result(spark, out) == _batch_episodes(spark, first + other + end)


def test_a_repeated_batch_changes_nothing(spark):
    land, out, ck = (_tmp(spark, n) for n in ("land", "out", "ck"))
    rows = _rows(4, 60)
    _land(spark, land, rows)
    _episodes(spark, land, out, ck, "1 hour")
    want = _stream_result(spark, out)
    # the stream is run again from the start into the same output: same batches, same folders
    _episodes(spark, land, out, _tmp(spark, "ck2"), "1 hour")
    assert _stream_result(spark, out) == want == _batch_episodes(spark, rows)


def test_lags_equal_the_batch(spark):
    land, out, ck = (_tmp(spark, n) for n in ("land", "out", "ck"))
    rows = [r for r in _rows(5, 120)]
    for part in (rows[:40], rows[40:]):
        _land(spark, land, part)
        s = ingest.read_stream(spark, land, spark.createDataFrame([], SCHEMA).schema, event_ts="ts")
        ingest.run_to_end(ordered.stream_lags(s, out, ck, ts="ts", value="v", tiebreak="id", series_cols=["s"], offsets=[1, 4],
                                              watermark="2 hours"))
    df = spark.createDataFrame(rows, SCHEMA).filter("v is not null and not isnan(v)")
    w = W.series_window(["s"], "ts", "id")
    want = sorted(map(tuple, df.select("s", "id", "v", F.lag("v", 1).over(w), F.lag("v", 4).over(w)).collect()), key=str)
    got = sorted((tuple(r) for r in ordered.results(spark, out, ["s"]).select("s", "id", "value", "lag_1", "lag_4").collect()), key=str)
    assert got == want


def test_python_is_called_by_groups_of_series(spark):
    """many series, with null, odd and large keys, take no more states than groups; results are the batch's."""
    land, out, ck = (_tmp(spark, n) for n in ("land", "out", "ck"))
    schema = "s string, k long, id long, ts timestamp_ntz, v double"
    keys = [(None if i == 0 else f'"{i}\\', None if i == 1 else (1 << 60) + i) for i in range(40)]
    rows = [(*key, 100 * j + i, T0 + dt.timedelta(hours=j, seconds=i), float(i * j)) for i, key in enumerate(keys) for j in range(6)]
    progress = []
    for lo, hi in ((0, 3), (3, 6)):
        spark.createDataFrame([r for r in rows if lo <= r[2] // 100 < hi], schema).write.mode("append").parquet(land)
        s = ingest.read_stream(spark, land, spark.createDataFrame([], schema).schema, event_ts="ts")
        q = ordered.stream_ordered(s, ordered.Lags([1], "id"), out, ck, ts="ts", value="v", tiebreak="id", series_cols=["s", "k"],
                                   watermark="1 hour", groups=5)
        ingest.run_to_end(q)
        progress.extend(q.recentProgress)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 5
    got = {tuple(r) for r in ordered.results(spark, out, ["s", "k"]).select("s", "k", "id", "value", "lag_1").collect()}
    assert got == {(a, b, n, v, None if n < 100 else v - n % 100) for a, b, n, _, v in rows} and len(got) == len(rows)


AIR = "s long, date timestamp_ntz, pm2_5 double, pm10 double"
MET = "s long, date timestamp_ntz, temperature_2m double"


def _hours(lo, hi, make, s=(1, 2)):
    return [make(k, T0 + dt.timedelta(hours=h), h) for k in s for h in range(lo, hi)]


def test_streamed_join_equals_the_batch(spark):
    air_at, met_at, out, alone, ck = (_tmp(spark, n) for n in ("air", "met", "out", "alone", "ck"))
    air = _hours(0, 60, lambda k, t, h: (k, t, None if h % 11 == 0 else float(h), 1.0 * h)) + [(None, T0, 1.0, 1.0)]
    met = _hours(5, 70, lambda k, t, h: (k, t, 20.0 + h), s=(1, 3))
    progress = []

    def run():
        sides = [ingest.read_stream(spark, at, spark.createDataFrame([], schema).schema, event_ts="date")
                 for at, schema in ((air_at, AIR), (met_at, MET))]
        q = joined.stream_merge(*sides, out, ck, on=["s", "date"], ts="date", watermark="4 hours", unmatched=alone)
        ingest.run_to_end(q)
        progress.extend(q.recentProgress)

    for lo, hi in ((0, 20), (20, 45), (45, 99)):
        at = [T0 + dt.timedelta(hours=x) for x in (lo, hi)]
        _land(spark, air_at, [r for r in air if at[0] <= r[1] < at[1]], AIR)
        # the weather lags behind by three hours
        late = [a - dt.timedelta(hours=3) for a in at]
        _land(spark, met_at, [r for r in met if (lo == 0 or late[0] <= r[1]) and (hi == 99 or r[1] < late[1])], MET)
        run()
    want = sorted(map(tuple, J.merge_sources(spark.createDataFrame(air, AIR), spark.createDataFrame(met, MET), on=["s", "date"])
                      .select("s", "date", "pm2_5", "pm10", "temperature_2m").collect()))
    back = spark.read.parquet(out).withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert sorted(map(tuple, back.select("s", "date", "pm2_5", "pm10", "temperature_2m").collect())) == want
    left = spark.read.parquet(alone).filter("side = 'left' and s = 2").count()
    assert 0 < left <= 60                           # given up once the watermark has passed
    # rows that wait are those of the delay, not of the whole stream
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress[-1:]) < 60
    # a row behind the watermark is late: dropped and counted
    _land(spark, air_at, [(1, T0 + dt.timedelta(hours=6), 5.0, 5.0)], AIR)
    before = spark.read.parquet(out).count()
    progress.clear()
    run()
    assert spark.read.parquet(out).count() == before
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1


def test_join_needs_the_time_and_names_of_its_own(spark):
    a = spark.createDataFrame([], AIR)
    with pytest.raises(ValueError):
        joined.stream_merge(a, a, "x", "y", on=["s"], ts="date")
    with pytest.raises(ValueError):
        joined.stream_merge(a, a, "x", "y", on=["s", "date"], ts="date")
