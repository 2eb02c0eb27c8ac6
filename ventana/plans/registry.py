"""Registry of named queries: Spark builder + DuckDB oracle text.

Results are "presented" before comparison: dates and timestamps become ISO
text (both engines hand them to pandas with different units), everything else
keeps its type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

DAY_FMT = "yyyy-MM-dd"
TS_FMT = "yyyy-MM-dd HH:mm:ss"
SQL_DAY_FMT = "%Y-%m-%d"
SQL_TS_FMT = "%Y-%m-%d %H:%M:%S"


def present(df: DataFrame) -> DataFrame:
    """Dates/timestamps -> ISO strings; other columns unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c, DAY_FMT).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, TS_FMT).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (+ oracle SQL)."""
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
