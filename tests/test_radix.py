"""Radix selection equals numpy's quantiles."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventana.operators import profiles as P
from ventana.operators import radix as R
from ventana.operators import stats as S

PROBS = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def _check(spark, values):
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g string, x double").repartition(4)
    got = {r.g: r for r in R.quantiles_long(df, ["x"], PROBS, ["g"]).collect()}
    for g, xs in values.items():
        own = np.sort([x for x in xs if x is not None and not math.isnan(x)])
        if not len(own):
            assert g not in got
            continue
        assert got[g].n == len(own) and got[g].column == "x"
        for i, p in enumerate(PROBS):
            at = (len(own) - 1) * p
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
            assert got[g][f"q{i}"] == want or math.isclose(got[g][f"q{i}"], want, rel_tol=1e-12), (g, p)


def test_values_of_all_kinds(spark, monkeypatch):
    draw = random.Random(2)
    values = {
        "even": [draw.random() for _ in range(3000)], "ties": [float(draw.randrange(3)) for _ in range(900)],
        "one": [7.5], "two": [1.0, 2.0], "same": [4.0] * 50, "none": [None, float("nan")],
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-100, 100) for _ in range(60)],
        "ends": [1.7e308, -1.7e308, 0.0, 1.0], "least": [5e-324, -5e-324, 0.0], "zeros": [0.0, -0.0, 0.0], None: [3.0, 1.0, 2.0]}
    _check(spark, values)
    monkeypatch.setattr(R, "DIGITS", 4)             # more rounds, the same values
    _check(spark, {k: values[k] for k in ("ties", "two", "one")})


def test_columns_and_groups_together(spark):
    df = spark.range(4000).select((F.col("id") % 2 * (F.col("id") % 7)).alias("g"), F.xxhash64("id").cast("double").alias("a"),
                                  (F.col("id") % 10).alias("b"), F.lit(None).cast("double").alias("c"))
    got = P.quantiles(df, value_cols=["a", "b", "c"], series_cols=["g"], distributed=True).orderBy("g").collect()
    want = P.quantiles(df, value_cols=["a", "b", "c"], series_cols=["g"]).orderBy("g").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0].asDict().keys() == want[0].asDict().keys()
    assert S.describe(df, ["a", "b", "c"], distributed=True).orderBy("column").collect() \
        == S.describe(df, ["a", "b", "c"]).orderBy("column").collect()
    assert sorted(map(tuple, S.box_stats(df, "b", ["g"], distributed=True).collect())) \
        == sorted(map(tuple, S.box_stats(df, "b", ["g"]).collect()))


def test_no_buffer_of_values_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, None)], "`a.b` int, `x y` double, _v double")
    out = R.quantiles_long(df, ["x y", "_v"], [0.5], ["a.b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert sorted((r["a.b"], r["column"], r.n, r.q0) for r in out.collect()) == [(1, "_v", 1, 5.0), (1, "x y", 2, 3.0)]
    assert R.quantiles_long(df.limit(0), ["x y"], [0.5]).count() == 0
    assert R.quantiles_wide(df.limit(0), ["x y"], {"m": 0.5}).first()[:] == (None,)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_groups(spark, seed):
    draw = random.Random(seed)
    _check(spark, {g: [draw.choice([draw.gauss(0, 1), round(draw.gauss(0, 1), 1), None]) for _ in range(draw.randrange(0, 400))]
                   for g in "abcdef"})


def test_box_stats_deal_no_rows_to_groups(spark):
    """the rows of a few groups are never dealt out by group; groups that are null or without values keep their row."""
    df = spark.createDataFrame([("a", float(i % 97) ** 3) for i in range(500)] + [("b", None), (None, 1.0), (None, 2.0)], "g string, x double")
    out = S.box_stats(df, "x", ["g"], distributed=True)
    got = {r.g: r for r in out.collect()}
    assert got == {r.g: r for r in S.box_stats(df, "x", ["g"]).collect()} and len(got) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[g#\d+\], \[g#\d+\], Inner", plan)
