"""Keep-first inserts into a table that is bucketed and sorted by its key.

The Parquet store of ``store`` finds a batch's stored keys by its time range. Where batches touch all of the
history (late corrections, many series), that range is the whole store, and the anti-join would shuffle it. Here the
store is a catalog table whose files are dealt by the key's hash, so that an insert shuffles the batch to the buckets
and reads the store where it lies: its plan has no exchange on the store's side.

The table has one writer at a time (appends are new files of the same buckets); readers see whole appends. Defined cases
are those of ``store``: the stored row always wins, the first row of a key in the batch does otherwise, nulls
of the order come last; a null key never equals a stored one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep_first


def create(spark: SparkSession, name: str, schema: T.StructType, key: Sequence[str], buckets: int,
           path: str | None = None) -> None:
    """An empty bucketed table; ``path`` puts its files into a folder of one's own."""
    empty = spark.createDataFrame([], schema)
    _writer(empty, key, buckets, path).mode("error").saveAsTable(name)


def _writer(df: DataFrame, key: Sequence[str], buckets: int, path: str | None = None):
    w = df.write.format("parquet").bucketBy(buckets, *key).sortBy(*key)
    return w.option("path", path) if path else w


def bucketing(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """Key columns and number of buckets of a table."""
    told = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "Num Buckets" not in told:
        raise ValueError(f"{name} is not bucketed")
    return [c.strip(" `") for c in told["Bucket Columns"].strip("[]").split(",")], int(told["Num Buckets"])


def new_rows(batch: DataFrame, name: str, order_col: str) -> DataFrame:
    """Rows of the batch whose key is not stored yet. The batch is dealt out like the table's buckets, so both its
    reduction to first rows and the anti-join use that one exchange."""
    spark = batch.sparkSession
    key, buckets = bucketing(spark, name)
    dealt = batch.repartition(buckets, *[F.col(f"`{k}`") for k in key])
    stored = spark.table(name).select(*[F.col(f"`{k}`") for k in key])
    # sorted runs merge with the store's sorted files; nothing of either side is held or sent as a whole
    return keep_first(dealt, key, order_col).join(stored.hint("merge"), key, "left_anti")


def insert_or_ignore(batch: DataFrame, name: str, order_col: str) -> None:
    """Appends the batch's new keys to the table."""
    key, buckets = bucketing(batch.sparkSession, name)
    columns = batch.sparkSession.table(name).columns
    rows = new_rows(batch, name, order_col).select(*[F.col(f"`{c}`") for c in columns])
    _writer(rows, key, buckets).mode("append").saveAsTable(name)
