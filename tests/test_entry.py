"""Driver contract: flagship runs, every query has a builder, oracles are a subset."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "aqi_level" in df.columns


def test_oracles_are_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
