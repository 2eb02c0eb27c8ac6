"""Rules D1-D9 and the label / calendar expressions on hand-made frames."""

import datetime as dt
import math

from pyspark.sql import functions as F

from ventana.functions import exprs as X
from ventana.operators import stats as S

from conftest import rows


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    r = X.nan_to_null(df).agg(F.avg("v"), F.count("v")).first()
    assert r[0] == 1.0 and r[1] == 1


def test_weekday_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5),)], "ts timestamp_ntz")
    out = X.calendar_parts(df, "ts").first()
    assert out["dayofweek"] == 0 and out["hour"] == 5 and out["month"] == 1
    assert out["date_str"] == "2024-01-01" and out["month_str"] == "Jan 2024"


def test_level_boundaries(spark):
    vals = [12.0, 12.01, 35.0, 35.25, 35.5, 55.0, 55.01, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got3 = [r[0] for r in df.select(X.level3("x")).collect()]
    assert got3 == ["Bon", "Moyen", "Moyen", "Moyen", "Moyen", "Mauvais", "Mauvais", "Mauvais"]
    got4 = [r[0] for r in df.select(X.level4("x")).collect()]
    assert got4 == ["Bon", "Modéré", "Modéré", "Mauvais", "Mauvais", "Mauvais", "Très Mauvais",
                    "Très Mauvais"]


def test_level_of_larger_value_null_rule(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, None), (40.0, 5.0)], "pm10 double, pm2_5 double")
    got = [r[0] for r in df.select(X.level_max("pm10", "pm2_5")).collect()]
    assert got == ["Mauvaise", "Bon", "Mauvaise"]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(X.safe_ratio("a", "b", 3)).collect()] == [None, 0.25]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(10)], "x double, k double")
    out = {(a, b): c for a, b, c in rows(S.corr_matrix(df, ["x", "k"]))}
    assert out[("x", "k")] is None and math.isclose(out[("x", "x")], 1.0)


def test_corr_equals_builtin_when_defined(spark):
    data = [(float(i), float(i * i % 7), None if i % 5 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    ours = df.agg(X.null_safe_corr("a", "b"), X.null_safe_corr("a", "c")).first()
    ref = df.agg(F.corr("a", "b"), F.corr("a", "c")).first()
    assert math.isclose(ours[0], ref[0], rel_tol=1e-12)
    assert math.isclose(ours[1], ref[1], rel_tol=1e-12)


def test_season_month_label_rain_cyclic(spark):
    df = spark.createDataFrame([(12, 0.5), (3, 1.0), (9, 3.0)], "m int, r double")
    out = rows(df.select(X.season("m"), X.month_label("m"), X.rain_class("r")))
    assert out[0] == ("Harmattan (Déc-Fév)", "Déc 2025", "blue")
    assert out[1] == ("Saison pluvieuse (Mar+)", "Mar 2026", "teal")
    assert out[2] == ("Saison pluvieuse (Mar+)", "Sept 2025", "coral")
    s, c = X.cyclic(F.lit(6))
    v = spark.range(1).select(s, c).first()
    assert math.isclose(v[0], 1.0) and abs(v[1]) < 1e-12


def test_alert_class_and_text(spark):
    df = spark.createDataFrame([("Très Mauvais", 26.845), ("Bon", 2.0), ("Modéré", None)],
                               "lab string, v double")
    out = rows(df.select(X.alert_class("lab"), X.with_unit("v")))
    assert out == [("alert-bad", "26.84 μg/m³"), ("alert-good", "2.00 μg/m³"), (None, None)]


def test_range_violation_counts_null_as_fine(spark):
    df = spark.createDataFrame([(-1.0,), (501.0,), (None,), (10.0,)], "pm2_5 double")
    assert df.filter(X.range_violation("pm2_5")).count() == 2
