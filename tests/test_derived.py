"""Windows framed by time and circular means (P27), against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ventana.operators import derived as D

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "s string, date timestamp_ntz, surface_pressure double, ozone double, relative_humidity_2m double, wind_direction_10m double"


def _rows(seed=1, n=400):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        if draw.random() < 0.8:                        # hours are missing
            out.append((draw.choice("ab"), T0 + dt.timedelta(hours=i), draw.choice([None, draw.uniform(990, 1030)]),
                        draw.uniform(0, 90), draw.choice([None, draw.uniform(20, 99)]), draw.choice([None, draw.uniform(0, 360)])))
    return out + out[5:8]                              # repeated times


def _near(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("slice_days", [None, 7])
def test_frames_follow_the_clock(spark, slice_days):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = D.derived_weather(df, series_cols=["s"], slice_seconds=slice_days and slice_days * D.DAY).collect()
    assert len(got) == len(rows)

    def mean(values):
        values = [v for v in values if v is not None]
        return sum(values) / len(values) if values else None

    for r in got:
        def held(lo, hi, i, shut=True):
            return [x[i] for x in rows if x[0] == r.s and (lo <= (r.date - x[1]).total_seconds() <= hi if shut
                                                           else lo <= (r.date - x[1]).total_seconds() < hi)]
        before = mean(held(3 * 3600, 3 * 3600, 2))
        want = None if before is None or r.surface_pressure is None else r.surface_pressure - before
        assert _near(r.pressure_change_3h, want)
        assert _near(r.ozone_lag_6h, mean(held(6 * 3600, 6 * 3600, 3)))
        assert _near(r.humidity_mean_7d, mean(held(0, 7 * 86400, 4, shut=False)))
        angles = [math.radians(a) for a in held(0, 6 * 3600, 5, shut=False) if a is not None]
        x, y = (mean([f(a) for a in angles]) for f in (math.cos, math.sin)) if angles else (None, None)
        assert _near(r.wind_mean_6h, None if x is None else math.degrees(math.atan2(y, x)) % 360)


def test_a_gap_gives_null_and_not_an_older_value(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), 1000.0 + h, 1.0, 50.0, 0.0) for h in (0, 1, 2, 4, 5, 7)]
    got = {r.date.hour: r.pressure_change_3h for r in D.derived_weather(
        spark.createDataFrame(rows, SCHEMA), series_cols=["s"]).collect()}
    assert got == {0: None, 1: None, 2: None, 4: 3.0, 5: 3.0, 7: 3.0}
    gap = [r for r in rows if r[1].hour != 4]
    got = {r.date.hour: r.pressure_change_3h for r in D.derived_weather(spark.createDataFrame(gap, SCHEMA), series_cols=["s"]).collect()}
    assert got[7] is None


def test_mean_direction(spark):
    def mean(pairs):
        df = spark.createDataFrame(pairs, "d double, w double")
        r = df.agg(D.mean_direction("d", "w").alias("m"), D.steadiness("d", "w").alias("s")).first()
        return r.m, r.s
    m, s = mean([(350.0, 1.0), (10.0, 1.0)])
    assert math.isclose(min(m, 360 - m), 0.0, abs_tol=1e-9) and math.isclose(s, math.cos(math.radians(10)))
    assert mean([(0.0, 1.0), (180.0, 1.0)])[0] is None           # cancels out
    m, _ = mean([(0.0, 3.0), (90.0, 1.0), (None, 9.0), (45.0, None)])
    assert math.isclose(m, math.degrees(math.atan2(1, 3)))
    assert mean([(None, 1.0)]) == (None, None) and mean([(10.0, 0.0)]) == (None, None)


def test_rows_without_time_and_clashing_names(spark):
    rows = [("a", None, 1.0, 2.0, 3.0, 4.0), ("a", None, 5.0, 6.0, 7.0, 8.0), ("a", T0, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_at": F.lit("x"), "_slice": F.lit("y"), "_own": F.lit("z")})
    out = D.derived_weather(df, series_cols=["s"])
    got = out.collect()
    assert len(got) == 3 and {(r["_at"], r["_slice"], r["_own"]) for r in got} == {("x", "y", "z")}
    assert {(r.date, r.humidity_mean_7d) for r in got} == {(None, None), (T0, 3.0)}
    assert D.derived_weather(df.limit(0), series_cols=["s"]).count() == 0


def test_look_ahead(spark):
    df = spark.range(50).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("t"),
                                F.col("id").cast("double").alias("v"))
    out = D.with_time_frames(df, ts="t", back=0, ahead=2 * D.HOUR, slice_seconds=5 * D.HOUR,
                             build=lambda w: {"next": F.max("v").over(w.between(0, 2 * D.HOUR))})
    assert all(r.next == min(r.v + 2, 49.0) for r in out.collect())
