"""Every registered query runs on the smallest tables; oracle columns match."""

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF001

# fitted with few rounds in test_learn.py
SLOW = {"gbt_fit_predict", "gbt_two_targets", "importances", "forecast_next", "forecast_next_day", "backtest_gbt",
        "gbt_attributions"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def test_every_query_runs_and_matches_oracle_columns(spark, duck):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    optional = set(E._optional()[0])            # tested in their own folder
    for name in sorted(set(qs) - SLOW - optional):
        df = qs[name](spark, SF001)
        n = df.count()
        assert n >= 0, name
        if name in sql:
            rel = duck.sql(sql[name])
            assert sorted(df.columns) == sorted(rel.columns), name
            assert len(rel.fetchall()) == n, name
