"""Keyed store, high-water mark, freshness gate, array responses, streams."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventana.sources import api, files, store
from ventana.streaming import ingest

from conftest import rows


def _tmp(spark, name):
    from ventana.session import checkpoint_dir
    return tempfile.mkdtemp(prefix=name + "-", dir=checkpoint_dir(spark))


def test_insert_or_ignore_first_wins_and_idempotent(spark):
    d = _tmp(spark, "store")
    target = os.path.join(d, "t")
    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([(1, t0, 5.0, 1)], "s long, date timestamp_ntz, v double, seq long")
    assert store.insert_or_ignore(first, target, ["s", "date"], "seq") == 1
    batch = spark.createDataFrame([(1, t0, 9.0, 2), (2, t0, 1.0, 3), (2, t0, 2.0, 4)],
                                  "s long, date timestamp_ntz, v double, seq long")
    assert store.insert_or_ignore(batch, target, ["s", "date"], "seq") == 1
    assert store.insert_or_ignore(batch, target, ["s", "date"], "seq") == 0
    got = sorted(rows(spark.read.parquet(target), "s", "v"))
    assert got == [(1, 5.0), (2, 1.0)]


def test_high_water_and_due(spark):
    stored = spark.createDataFrame([(1, dt.datetime(2024, 1, 10, 5)), (3, dt.datetime(2025, 12, 31))],
                                   "k long, date timestamp_ntz")
    series = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    hw = {r["k"]: str(r["start_date"]) for r in
          store.high_water(stored, series, key="k", end="2025-12-31").collect()}
    assert hw == {1: "2024-01-11", 2: "2025-09-30"}
    now = dt.datetime(2024, 1, 10, 12)
    log = spark.createDataFrame([(2, now - dt.timedelta(hours=47)), (3, now - dt.timedelta(hours=48))],
                                "k long, last_collect timestamp_ntz")
    due = {r["k"]: r["due"] for r in
           store.due_series(log, series, key="k", now="2024-01-10 12:00:00").collect()}
    assert due == {1: True, 2: False, 3: True}


RESPONSE = "start long, end long, step_s int, utc_offset_s int, v array<double>"


def test_array_response_end_exclusive(spark):
    df = spark.createDataFrame([(0, 3 * 3600, 3600, 3600, [1.0, 2.0, 3.0])], RESPONSE)
    r = rows(api.expand_response(df, variables=["v"]).orderBy("date"), "date", "v")
    assert len(r) == 3 and r[0] == (dt.datetime(1970, 1, 1, 1), 1.0)
    part = spark.createDataFrame([(0, 9000, 3600, 0, [1.0, 2.0, 3.0])], RESPONSE)    # 2.5 steps hold three times
    assert api.expand_response(part, variables=["v"]).count() == 3


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0, 5.0], [1.0], [], None])
def test_array_response_of_another_length_fails(spark, values):
    df = spark.createDataFrame([(0, 3 * 3600, 3600, 0, values)], RESPONSE)
    with pytest.raises(Exception, match="array response"):
        api.expand_response(df, variables=["v"]).collect()
    with pytest.raises(Exception, match="array response"):
        api.expand_response(df, variables=["v"]).count()


DOC = '{"records": [{"date": "2024-01-01", "pm2_5": 3.5}, {"date": "2024-01-02", "pm2_5": null}]}'
FIELDS = "date string, pm2_5 double"


def test_json_records_document(spark):
    df = spark.createDataFrame([(DOC,), ('{"records": []}',)], "doc string")
    assert rows(files.explode_records(df, "doc", FIELDS)) == [("2024-01-01", 3.5), ("2024-01-02", None)]


@pytest.mark.parametrize("bad", ["{not json", None, "", "{}", '{"records": null}', '{"records": [{"pm2_5": "x"}]}'])
def test_bad_documents_fail_or_are_set_aside(spark, bad):
    df = spark.createDataFrame([(1, DOC), (2, bad)], "id long, doc string")
    with pytest.raises(Exception):
        files.explode_records(df, "doc", FIELDS).collect()
    good, other = files.bad_documents(df, "doc", FIELDS)
    assert rows(other, "id") == [(2,)]
    assert files.explode_records(good, "doc", FIELDS).count() == 2


def test_fallback_across_formats(spark):
    d = _tmp(spark, "fallback")
    schema = T._parse_datatype_string(FIELDS)
    missing = [os.path.join(d, "no.parquet"), (os.path.join(d, "no.json"), "records"), "table:no_such_table"]
    assert files.read_first_available(spark, missing, schema).count() == 0
    csv = os.path.join(d, "c.csv")
    with open(csv, "w") as f:
        f.write("pm2_5,id,date\n1.5,9,2024-01-01\n,8,2024-01-02\n")
    got = files.read_first_available(spark, [*missing, (csv, "csv")], schema)
    assert rows(got) == [("2024-01-01", 1.5), ("2024-01-02", None)]
    doc = os.path.join(d, "d.json")
    with open(doc, "w") as f:
        f.write(DOC)
    assert files.read_first_available(spark, [(doc, "records"), (csv, "csv")], schema).count() == 2
    broken = os.path.join(d, "broken.parquet")
    with open(broken, "w") as f:
        f.write("not a parquet file")
    with pytest.raises(Exception):
        files.read_first_available(spark, [broken, (csv, "csv")], schema).collect()


def test_unreadable_store_is_not_an_empty_store(spark):
    d = _tmp(spark, "damaged")
    target = os.path.join(d, "t")
    batch = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5.0, 1)], "s long, date timestamp_ntz, v double, seq long")
    assert store.read_store(spark, target) is None
    os.makedirs(target)
    assert store.read_store(spark, target) is None
    assert store.insert_or_ignore(batch, target, ["s", "date"], "seq") == 1
    for folder, _, names in os.walk(target):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "w") as f:
                    f.write("damaged")
                if os.path.exists(os.path.join(folder, f".{name}.crc")):
                    os.remove(os.path.join(folder, f".{name}.crc"))
    with pytest.raises(Exception):
        store.insert_or_ignore(batch, target, ["s", "date"], "seq")


def test_keep_first_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 5, None), (2, 5, None), (None, 3, "x"), (None, 4, "y")],
                               "k long, seq long, v string")
    got = sorted(rows(store.keep_first(df, ["k"], "seq")), key=str)
    assert len(got) == 3 and got[1] == (2, 5, None) and got[2] == (None, 3, "x") and got[0][:2] == (1, 1)
    plan = store.keep_first(df, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_keep_first_keeps_keys_whose_orders_are_null(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, 3, "c"), (2, None, "d"), (3, 1, "e")], "k long, seq long, v string")
    for n in (1, 4):
        got = sorted(rows(store.keep_first(df.repartition(n), ["k"], "seq")), key=str)
        assert [g[0] for g in got] == [1, 2, 3] and got[1:] == [(2, 3, "c"), (3, 1, "e")]
    plan = store.keep_first(df, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan.split("Exchange")[1]     # copies go before it
    assert store.keep_first(df.withColumn("rank", F.lit("kept")), ["k"], "seq").filter("rank = 'kept'").count() == 3


def test_restarted_stream_resumes_and_adds_nothing_twice(spark):
    d = _tmp(spark, "restart")
    land, target, ck = (os.path.join(d, x) for x in ("landing", "t", "ck"))
    t = dt.datetime(2024, 1, 1)
    _landing(spark, land, "f1", [(1, t, 1, 1.0), (2, t, 2, 2.0)])
    schema = spark.read.parquet(os.path.join(land, "f1")).schema

    def run(checkpoint):
        s = spark.readStream.schema(schema).parquet(land + "/*")
        q = ingest.stream_insert(s, target, checkpoint, key=["k", "ts"], order_col="id", ts="ts")
        ingest.run_to_end(q)
        return sum(p["numInputRows"] for p in q.recentProgress)

    assert run(ck) == 2
    assert run(ck) == 0                                   # resumed: nothing is read again
    _landing(spark, land, "f2", [(3, t, 1, 9.0), (4, t, 3, 4.0)])
    assert run(ck) == 2
    assert run(os.path.join(d, "ck2")) == 4               # a new checkpoint reads all files again
    assert sorted(rows(spark.read.parquet(target), "id")) == [(1,), (2,), (4,)]


def test_csv_roundtrip(spark):
    d = _tmp(spark, "csv")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 2), 1.5), (dt.datetime(2024, 1, 1, 1), float("nan"))],
                               "date timestamp_ntz, pm2_5 double")
    files.write_csv(df, os.path.join(d, "o"), ts="date")
    back = files.read_series_csv(spark, os.path.join(d, "o"), "date string, pm2_5 double")
    assert sorted(rows(back, "pm2_5"), key=str) == [(1.5,), (None,)]


def _landing(spark, d, name, data):
    p = os.path.join(d, name)
    spark.createDataFrame(data, "id long, ts timestamp_ntz, k long, v double").coalesce(1) \
        .write.parquet(p)
    return p


def test_stream_late_data_dropped_and_equals_batch(spark):
    d = _tmp(spark, "late")
    land = os.path.join(d, "landing")
    t = dt.datetime(2024, 1, 10, 12)
    # f1 moves the watermark to t - 2 days; Spark drops late rows against the
    # watermark of the previous batch, so the late row arrives two batches later
    _landing(spark, land, "f1", [(1, t, 1, 10.0), (2, t - dt.timedelta(hours=3), 1, 20.0)])
    _landing(spark, land, "f2", [(3, t - dt.timedelta(hours=1), 1, 30.0)])
    _landing(spark, land, "f3", [(4, t - dt.timedelta(days=5), 1, 99.0),
                                 (5, t - dt.timedelta(minutes=30), 1, 40.0)])
    schema = spark.read.parquet(os.path.join(land, "f1")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land + "/*") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    ingest.run_to_end(ingest.stream_daily(s, out, ck, ts="ts", value_col="v", series_cols=["k"]))
    res = ingest.latest_versions(spark.read.parquet(out), ["k", "day_start"])
    got = rows(res, "mean", "n")
    assert got == [(25.0, 4)]            # the 5-day-late row is dropped, the 1-hour-late kept


def test_stream_insert_equals_batch(spark):
    d = _tmp(spark, "ins")
    land = os.path.join(d, "landing")
    t = dt.datetime(2024, 1, 1)
    _landing(spark, land, "f1", [(1, t, 1, 1.0), (2, t, 1, 2.0)])
    _landing(spark, land, "f2", [(3, t, 1, 3.0), (4, t, 2, 4.0)])
    schema = spark.read.parquet(os.path.join(land, "f1")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land + "/*")
    target, ck = os.path.join(d, "t"), os.path.join(d, "ck")
    ingest.run_to_end(ingest.stream_insert(s, target, ck, key=["k", "ts"], order_col="id", ts="ts"))
    assert sorted(rows(spark.read.parquet(target), "id")) == [(1,), (4,)]


def test_stream_daily_equals_batch_over_several_batches(spark):
    d = _tmp(spark, "sdb")
    land = os.path.join(d, "landing")
    t0 = dt.datetime(2024, 1, 1)
    rows_all = [(i, t0 + dt.timedelta(hours=3 * i), i % 3, float(i % 11)) for i in range(60)]
    for j in range(4):                     # four files in time order, one per micro-batch
        _landing(spark, land, f"f{j}", rows_all[j * 15:(j + 1) * 15])
    schema = spark.read.parquet(os.path.join(land, "f0")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land + "/*") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    ingest.run_to_end(ingest.stream_daily(s, out, ck, ts="ts", value_col="v", series_cols=["k"]))
    got = sorted((r["k"], r["day_start"].date(), round(r["mean"], 9), r["n"]) for r in
                 ingest.latest_versions(spark.read.parquet(out), ["k", "day_start"]).collect())
    batch = spark.createDataFrame(rows_all, "id long, ts timestamp_ntz, k long, v double") \
        .groupBy("k", F.to_date("ts").alias("d")).agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    want = sorted((r["k"], r["d"], round(r["m"], 9), r["n"]) for r in batch.collect())
    assert got == want


def test_compacted_change_log_goes_on(spark):
    d = _tmp(spark, "compact")
    land, out, new, ck = (os.path.join(d, x) for x in ("landing", "out", "new", "ck"))
    t = dt.datetime(2024, 1, 1)
    _landing(spark, land, "f1", [(1, t, 1, 1.0), (2, t + dt.timedelta(hours=1), 1, 3.0)])
    schema = spark.read.parquet(os.path.join(land, "f1")).schema
    names = schema.names

    def run(path):
        s = ingest.read_stream(spark, land + "/*", schema, event_ts="ts")
        ingest.run_to_end(ingest.stream_daily(s, path, ck, ts="ts", value_col=names[-1], series_cols=["k"]))
        return {r.k: (r["mean"], r.n) for r in ingest.latest_versions(spark.read.parquet(path), ["k", "day_start"]).collect()}

    assert run(out) == {1: (2.0, 2)}
    _landing(spark, land, "f2", [(3, t + dt.timedelta(hours=2), 1, 5.0), (4, t, 2, 7.0)])
    run(out)
    ingest.compact_versions(spark, out, new, ["k", "day_start"])
    assert spark.read.parquet(new).count() == 2 < spark.read.parquet(out).count()
    _landing(spark, land, "f3", [(5, t + dt.timedelta(hours=3), 2, 9.0)])
    assert run(new) == {1: (3.0, 3), 2: (8.0, 2)}


def test_scratch_of_one_machine_is_refused_on_a_cluster():
    from ventana.session import require_shared
    for folder, master in (("file:/tmp/w", "local[4]"), ("/tmp/w", "local-cluster[2,1,512]"), ("hdfs://n/w", "yarn"), ("s3a://b/w", "spark://h:7077")):
        require_shared(folder, master)
    for folder in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            require_shared(folder, "yarn")
