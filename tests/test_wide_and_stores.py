"""Matrix-product correlations, sketches over time, Variant documents, the bucketed store."""

import math
import os
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ventana.operators import gram as G
from ventana.operators import sketches as K
from ventana.operators import stats as S
from ventana.session import checkpoint_dir
from ventana.sources import bucketed, documents


# --- correlations -----------------------------------------------------------------------

def _near(a, b, tol=1e-9):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=tol, abs_tol=tol))


@pytest.mark.parametrize("series", [(), ("g",)])
@pytest.mark.parametrize("listwise", [False, True])
def test_correlations_equal_the_expressions(spark, series, listwise):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)), columns=list("abcd"))
    pdf["b"] = pdf.a * 2 + rng.normal(size=400) * 0.1 + 1e6        # far from zero
    pdf["e"] = 7.25                                                 # constant
    pdf["f"] = np.where(rng.random(400) < 0.9, np.nan, pdf.c)
    pdf["g"] = rng.integers(0, 3, 400)
    pdf.loc[rng.random(400) < 0.1, "d"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    cols = list("abcdef")
    key = [*series, "col_a", "col_b"]
    got = {tuple(r[k] for k in key): r["corr"] for r in G.corr_wide(df, cols, listwise, series).collect()}
    want = {tuple(r[k] for k in key): r["corr"] for r in S.corr_matrix(df, cols, listwise, series).collect()}
    assert got.keys() == want.keys()
    # a constant has no correlation (the expressions may find one in rounding noise)
    assert all(v is None for k, v in got.items() if "e" in k[-2:])
    assert [(k, got[k], want[k]) for k in want if "e" not in k[-2:] and not _near(got[k], want[k], 1e-8)] == []


def test_three_hundred_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(250, 300))
    x[:, 1] = x[:, 0] + 0.2 * rng.normal(size=250)
    names = [f"c{i}.x" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(4)
    got = G.corr_wide(df, names)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 400_000     # no expression per pair
    want = np.corrcoef(x, rowvar=False)
    rows = got.collect()
    assert len(rows) == 90_000
    at = {n: i for i, n in enumerate(names)}
    assert max(abs(r["corr"] - want[at[r["col_a"]], at[r["col_b"]]]) for r in rows) < 1e-9


def test_many_series_flush_and_empty(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_SERIES", 2)
    df = spark.range(200).select((F.col("id") % 9).alias("s"), F.xxhash64("id").cast("double").alias("a"),
                                 F.xxhash64("id", F.lit(1)).cast("double").alias("b"))
    got = {(r.s, r.col_a, r.col_b): r["corr"] for r in G.corr_wide(df, ["a", "b"], series_cols=["s"]).collect()}
    want = {(r.s, r.col_a, r.col_b): r["corr"] for r in S.corr_matrix(df, ["a", "b"], series_cols=["s"]).collect()}
    assert got.keys() == want.keys() and all(_near(got[k], want[k]) for k in want)
    assert [r["corr"] for r in G.corr_wide(df.limit(0), ["a", "b"]).collect()] == [None] * 4
    assert G.corr_wide(df.limit(0), ["a", "b"], series_cols=["s"]).count() == 0


# --- sketches ----------------------------------------------------------------------------

def test_merged_days_answer_within_the_error(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("d"), F.randn(3).alias("x"), (F.col("id") % 5000).alias("u")) \
        .withColumn("ts", F.timestamp_add("DAY", F.col("d").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    days = K.daily_sketches(df, ts="ts", value_cols=["x"], distinct_cols=["u"])
    assert days.count() == 30
    one = K.merged(days.filter("day < '2024-01-16'")).select(
        "n", *[K.quantile("x", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.95))], K.distinct("u").alias("u")).first()
    part = df.filter("d < 15")
    assert one.n == part.count()
    for q, v in zip((0.01, 0.5, 0.95), (one.q0, one.q1, one.q2)):
        rank = part.filter(F.col("x") <= v).count() / one.n
        assert abs(rank - q) <= K.rank_error() + 1 / one.n
    exact = part.select("u").distinct().count()
    assert abs(one.u - exact) <= 4 * K.distinct_error() * exact


def test_days_without_values(spark):
    df = spark.createDataFrame([("2024-01-01", None, None), ("2024-01-02", float("nan"), 1), ("2024-01-03", 5.0, 1)],
                               "ts string, x double, u long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    one = K.merged(K.daily_sketches(df, ts="ts", value_cols=["x"], distinct_cols=["u"])).select(
        "n", K.quantile("x", 0.5).alias("m"), K.distinct("u").alias("u")).first()
    assert (one.n, one.m, one.u) == (3, 5.0, 1)
    assert K.rank_error(800) < K.rank_error(200)


# --- documents ---------------------------------------------------------------------------

def test_documents_of_any_form(spark):
    texts = ['{"a": 1, "b": {"c": "x", "d.e": 2.5}}', '{"a": "t", "b": null, "l": [1, {"z": 2}]}', '[1]', '3', '"s"', '{}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    doc = documents.parsed(df, "t")
    got = {(r.path, r.type): r.n for r in documents.field_types(doc, "document").collect()}
    assert got == {("$.a", "BIGINT"): 1, ("$.a", "STRING"): 1, ("$.b", "OBJECT"): 1, ("$.b", "VOID"): 1, ("$.b.c", "STRING"): 1,
                   ("$.b.d.e", "DECIMAL"): 1, ("$.l", "ARRAY"): 1}
    read = documents.with_fields(doc, "document", {"a": ("$.a", "int"), "c": ("$.b.c", "string"), "z": ("$.l[1].z", "int")})
    assert [(r.a, r.c, r.z) for r in read.collect()] == [(1, "x", None), (None, None, 2)] + [(None, None, None)] * 4
    assert "a" in documents.common_schema(doc.filter("t like '{%'"), "document")


def test_bad_documents_fail_or_are_set_aside(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), (None,), ("",)], "t string")
    assert sorted(str(r.t) for r in documents.bad_documents(df, "t").collect()) == ["", "None", '{"a": ']
    with pytest.raises(Exception, match="not a JSON document"):
        documents.parsed(df, "t").select(F.to_json("document")).collect()
    assert documents.parsed(df.filter("t like '%}'"), "t").select(documents.field("document", "$.a", "int").alias("a")).first().a == 1


# --- bucketed store ------------------------------------------------------------------------

SCHEMA = "k long, d string, seq long, v double"


def test_bucketed_inserts(spark):
    name = "b_" + uuid.uuid4().hex
    path = os.path.join(checkpoint_dir(spark), name)
    schema = spark.createDataFrame([], SCHEMA).schema
    bucketed.create(spark, name, schema, ["k", "d"], 4, path)
    assert bucketed.bucketing(spark, name) == (["k", "d"], 4)
    draw = random.Random(1)
    rows = [(draw.randrange(40), draw.choice("xyz"), draw.choice([None, *range(5)]), float(i)) for i in range(300)]
    held = {}
    for part in (rows[:120], rows[80:], rows):
        batch = spark.createDataFrame(part, SCHEMA).repartition(3)
        new = bucketed.new_rows(batch, name, "seq")
        bucketed.insert_or_ignore(batch, name, "seq")
        first = {}
        for r in part:
            if r[:2] not in held:
                first.setdefault(r[:2], []).append(r)
        for key, found in first.items():
            held[key] = min((r[2] is None, r[2] or 0) for r in found)
        got = {(r.k, r.d): (r.seq is None, r.seq or 0) for r in spark.table(name).collect()}
        assert got == held and spark.table(name).count() == len(held)
    plan = new._jdf.queryExecution().executedPlan().toString()
    store_side = plan[plan.index(name):] if name in plan else plan
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan, plan
    assert "Exchange" not in store_side
    with pytest.raises(ValueError):
        spark.range(1).createOrReplaceTempView("plain_view")
        bucketed.bucketing(spark, "plain_view")
    spark.sql(f"DROP TABLE {name}")
