"""File scans and sinks.

Scans take explicit schemas (no inference pass over the data), turn NaN into
NULL once (rule D1) and never sort: order lives in the windows that need it.
Exports that promise an order range-partition on (day, ts), so a hot day is
split over several tasks instead of landing in one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null
from ..session import path_exists


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType | str, *,
                    ts: str = "date", ts_format: str | None = None) -> DataFrame:
    """CSV with a header, explicit schema; the time column parsed as UTC."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == ts else f
                                for f in schema.fields])
    df = spark.read.schema(text_schema).option("header", True).option("mode", "PERMISSIVE") \
        .csv(path)
    parsed = F.to_timestamp(F.col(ts), ts_format) if ts_format else F.to_timestamp(F.col(ts))
    return nan_to_null(df.withColumn(ts, parsed))


def read_series_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (filters and column selection reach the scan)."""
    return nan_to_null(spark.read.parquet(path))


def read_ordered_table(spark: SparkSession, table: str, cols: Sequence[str] | None = None,
                       ts: str = "date") -> DataFrame:
    """S3: catalog table, selected columns, ordered by time (ORDER BY date ASC)."""
    df = spark.table(table)
    return (df.select(*cols) if cols else df).orderBy(ts)


def read_first_available(spark: SparkSession, sources: Sequence[str | tuple[str, str]],
                         schema: T.StructType) -> DataFrame:
    """The first source that exists, else an empty frame with the schema.

    A source is a path (Parquet), a (path, format) pair -- ``parquet``, ``csv`` with a header,
    ``json`` (one record per line) or ``records`` (documents ``{"records": [...]}``) -- or
    ``table:name``. Only a source that is not there is passed over; one that is there and
    cannot be read fails.
    """
    for source in sources:
        path, fmt = (source, "parquet") if isinstance(source, str) else source
        if path.startswith("table:"):
            if spark.catalog.tableExists(path[len("table:"):]):
                return spark.table(path[len("table:"):])
            continue
        if not path_exists(spark, path):
            continue
        if fmt == "parquet":
            return nan_to_null(spark.read.parquet(path))
        if fmt == "records":
            text = spark.read.text(path, wholetext=True)
            return nan_to_null(explode_records(text, "value", schema))
        if fmt == "csv":
            # columns are taken by name, whatever their order in the file
            head = spark.read.option("header", True).csv(path)
            missing = [f.name for f in schema.fields if f.name not in head.columns]
            if missing:
                raise ValueError(f"{path}: no column {', '.join(missing)}")
            return nan_to_null(head.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                                             for f in schema.fields]))
        return nan_to_null(spark.read.schema(schema).option("mode", "FAILFAST").format(fmt).load(path))
    return spark.createDataFrame([], schema)


_CORRUPT = "_corrupt_document"


def _parsed_records(df: DataFrame, json_col: str, record_schema: T.StructType | str, key: str | None):
    """(frame with ``_d``, its records as an array, whether the document is bad)."""
    if isinstance(record_schema, str):
        record_schema = T._parse_datatype_string(record_schema)
    fields = [T.StructField(key, T.ArrayType(record_schema))] if key else list(record_schema.fields)
    doc = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = df.withColumn("_d", F.from_json(F.col(json_col), doc, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    bad = F.col("_d").isNull() | F.col(f"_d.{_CORRUPT}").isNotNull()
    if key:
        rows = F.col(f"_d.{key}")
        bad = bad | rows.isNull()
    else:
        rows = F.array(F.struct(*[F.col(f"_d.`{f.name}`").alias(f.name) for f in record_schema.fields]))
    return parsed, rows, bad


def explode_records(df: DataFrame, json_col: str, record_schema: T.StructType | str,
                    key: str | None = "records", keep: Sequence[str] = ()) -> DataFrame:
    """JSON text -> rows. With ``key``, the document is ``{"records": [...]}``
    and each record becomes a row; without, each text is one record.

    A document that is null, malformed, does not fit the schema or lacks the key
    fails the job; ``bad_documents`` lists such documents, so that a caller can
    set them aside first.
    """
    parsed, rows, bad = _parsed_records(df, json_col, record_schema, key)
    message = F.concat(F.lit("not a document of records: "),
                       F.coalesce(F.left(F.col(json_col), F.lit(200)), F.lit("null")))
    checked = F.when(bad, F.raise_error(message)).otherwise(rows)
    return parsed.select(*keep, F.inline(checked))


def bad_documents(df: DataFrame, json_col: str, record_schema: T.StructType | str,
                  key: str | None = "records") -> tuple[DataFrame, DataFrame]:
    """S5 with bad documents set aside: (rows whose document ``explode_records`` takes, the others)."""
    parsed, _, bad = _parsed_records(df, json_col, record_schema, key)
    bad = F.coalesce(bad, F.lit(True))
    return parsed.filter(~bad).drop("_d"), parsed.filter(bad).drop("_d")


def write_csv(df: DataFrame, path: str, *, cols: Sequence[str] | None = None, ts: str = "date",
              mode: str = "overwrite") -> None:
    """Fixed column list, ordered by time, with header."""
    out = df.select(*cols) if cols else df
    out.orderBy(ts).write.mode(mode).option("header", True).csv(path)


def write_parquet_by_day(df: DataFrame, path: str, *, ts: str = "date", day_col: str = "day",
                         mode: str = "overwrite", partitions: int | None = None) -> None:
    """Parquet laid out by day, rows ordered by time inside each file.

    Range partitioning on (day, ts) keeps days contiguous and splits a heavy
    day over several tasks; partition pruning on ``day`` then serves any
    time-bounded read.
    """
    staged = df.withColumn(day_col, F.to_date(ts))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (staged.repartitionByRange(n, day_col, ts).sortWithinPartitions(day_col, ts)
           .write.mode(mode).partitionBy(day_col).parquet(path))


def export_both(df: DataFrame, csv_path: str, parquet_path: str, *, ts: str = "date",
                cols: Sequence[str] | None = None) -> None:
    """One computation, two sinks (the frame is persisted for the second)."""
    cached = df.persist()
    try:
        write_csv(cached, csv_path, cols=cols, ts=ts)
        write_parquet_by_day(cached, parquet_path, ts=ts)
    finally:
        cached.unpersist()


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested report to JSON."""
    report.coalesce(1).write.mode(mode).json(path)


def read_report_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a JSON report (or baseline metrics) back."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.option("multiLine", True).json(path)


def baseline_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """Baseline metrics (a small dict of numbers) as a one-row frame."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(metrics)]))
