"""Presentation, sampling, joins, fallbacks, exports."""

import datetime as dt
import os
import tempfile

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventana.operators import joins as J
from ventana.operators import sampling as SM
from ventana.operators import stats as S
from ventana.plans.registry import present
from ventana.session import checkpoint_dir
from ventana.sources import files

from conftest import rows


def test_present_turns_times_into_text(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), 1)],
                               "d date, t timestamp_ntz, n int")
    assert rows(present(df)) == [("2024-01-02", "2024-01-02 03:04:05", 1)]


def test_hashed_sample_is_repeatable_and_bounded(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r["k"] for r in SM.hashed_sample(df, ["k"], n=20, seed=7).collect()]
    b = [r["k"] for r in SM.hashed_sample(df, ["k"], n=20, seed=7).collect()]
    c = [r["k"] for r in SM.hashed_sample(df, ["k"], n=20, seed=8).collect()]
    assert a == b and len(a) == 20 and a != c
    assert SM.hashed_sample(df.limit(5), ["k"], n=20).count() == 5


def test_threshold_status_classes(spark):
    means = spark.createDataFrame([(13.0, 31.0, 50.0)], "pm2_5 double, pm10 double, ozone double")
    out = {r["measure"]: (r["gauge_class"], r["status"], r["value_text"])
           for r in J.threshold_status(means).collect()}
    assert out == {"pm2_5": ("danger", "Dépassé", "13.00 μg/m³"),
                   "pm10": ("amber", "OK", "31.00 μg/m³"),
                   "ozone": ("teal", "OK", "50.00 μg/m³")}


def test_merge_reports_lost_rows(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, 1.0)], "t long, pm10 double, pm2_5 double")
    b = spark.createDataFrame([(1, 20.0), (2, 21.0), (4, 22.0)], "t long, temperature_2m double")
    before, after = Observation("before"), Observation("after")
    out = J.merge_sources(a, b, on=["t"], observations=(before, after))
    assert out.count() == 1
    assert before.get["rows"] == 2 and after.get["rows"] == 1


def test_fallback_source_gives_empty_frame(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    df = files.read_first_available(spark, ["/nonexistent/x.parquet", "/nonexistent/y.parquet"], schema)
    assert df.count() == 0 and df.schema == schema


def test_day_layout_and_fit_line(spark):
    d = tempfile.mkdtemp(prefix="pq-", dir=checkpoint_dir(spark))
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h))
                                for h in range(0, 48, 6)],
                               "date timestamp_ntz, x double")
    files.write_parquet_by_day(df, os.path.join(d, "o"))
    assert sorted(p for p in os.listdir(os.path.join(d, "o")) if p.startswith("day=")) == \
        ["day=2024-01-01", "day=2024-01-02"]
    line = S.linreg(df.withColumn("y", 2 * F.col("x") + 1), x="x", y="y")
    pts = S.fit_line(line, 5).orderBy("i").collect()
    assert len(pts) == 5 and abs(pts[-1]["y_fit"] - 85.0) < 1e-9


def test_checkpoint_dir_comes_from_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    assert d and (configured is None or d == configured)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_cluster_conf_sizes_from_cores():
    from ventana.session import cluster_conf
    c = cluster_conf(8000)
    assert c["spark.sql.shuffle.partitions"] == "32000"
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert cluster_conf(8)["spark.sql.shuffle.partitions"] == "200"


def test_fused_flagged_days_equal_join_form(spark):
    from ventana.operators import profiles as P
    from ventana.operators import resample as R
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h % 17), float(h % 5),
             1 if h % 23 == 0 else 0) for h in range(24 * 6)]
    df = spark.createDataFrame(data, "date timestamp_ntz, pm2_5 double, pm10 double, anomaly int")
    joined = J.flagged_days(R.daily_mean(df, ts="date", value_cols=["pm2_5", "pm10"]),
                            P.daily_flag_max(df, ts="date", flag_col="anomaly"))
    fused = J.flagged_days_fused(df, ts="date", value_cols=["pm2_5", "pm10"])
    cols = ["date_str", "pm2_5", "pm10", "anomaly"]
    assert sorted(rows(joined, *cols)) == sorted(rows(fused, *cols)) and fused.count() > 0


def test_fallback_to_catalog_table(spark):
    spark.createDataFrame([(1,), (2,)], "a long").createOrReplaceTempView("fallback_t")
    schema = T.StructType([T.StructField("a", T.LongType())])
    df = files.read_first_available(spark, ["/nonexistent/z.parquet", "table:fallback_t"], schema)
    assert sorted(rows(df)) == [(1,), (2,)]


def test_complete_rows_filter_and_raise(spark):
    import pytest
    from ventana.operators import columns as C
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    assert C.complete_rows(df, ["a", "b"]).count() == 1
    with pytest.raises(Exception):
        C.complete_rows(df, ["a", "b"], raise_on_null=True).collect()
    aligned = C.align_features(df, ["b", "c", "a"])
    assert aligned.columns == ["b", "c", "a"] and C.missing_columns(df, ["a", "c"]) == ["c"]


def test_assign_back_fills_rows_outside_subset(spark):
    all_rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    subset = spark.createDataFrame([(2, 1)], "id long, anomaly int")
    out = dict(rows(J.assign_back(all_rows, subset, key=["id"], cols=["anomaly"], fill={"anomaly": 0})))
    assert out == {1: 0, 2: 1, 3: 0}


def test_remaining_helpers(spark):
    from ventana.functions import values as V
    from ventana.functions.exprs import flag_to_int
    from ventana.session import cut_lineage
    from ventana.sources import store
    base = files.baseline_frame(spark, V.BASELINE_METRICS).first()
    assert base["mae_pm25"] == 2.0927 and base["mse_aqi"] == 2.3403
    sch = store.store_schema(["pm2_5"], ["station"])
    assert [f.name for f in sch.fields] == ["station", "date", "pm2_5", "created_at"]
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0)], "k long, v double")
    assert [r["k"] for r in SM.top_n(df, "v", 2, "k").collect()] == [2, 3]
    flags = spark.createDataFrame([(None,), (True,), (False,)], "f boolean")
    assert [r[0] for r in flags.select(flag_to_int("f")).collect()] == [0, 1, 0]
    cut = cut_lineage(df.withColumn("w", F.col("v") * 2))
    assert cut.count() == 4 and "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()
