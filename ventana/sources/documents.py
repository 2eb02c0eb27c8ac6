"""JSON documents whose schema is not known beforehand, as Variant columns.

``files.read_json_records`` needs a schema and fails on documents that do not follow it. Here a document is parsed once
into a Variant, which keeps every field with its own type; fields are then read by path, each into the type asked for,
and a report tells which fields occur with which types. Text that is no JSON document fails, as in ``files``, or is set
aside; a field that is absent, or whose value cannot become the type asked for, is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text_col: str, out: str = "document") -> DataFrame:
    """``df`` with the text as Variant; a row whose text is null or no JSON document fails the query."""
    text = F.col(f"`{text_col}`")
    doc = F.try_parse_json(text)
    bad = F.raise_error(F.concat(F.lit("not a JSON document: "), F.coalesce(F.substring(text, 1, 200), F.lit("null"))))
    return df.withColumn(out, F.when(doc.isNull(), bad.cast("variant")).otherwise(doc))


def bad_documents(df: DataFrame, text_col: str) -> DataFrame:
    """The rows that ``parsed`` would fail on."""
    return df.filter(F.try_parse_json(F.col(f"`{text_col}`")).isNull())


def field(document: str | Column, path: str, kind: str) -> Column:
    """The field at ``path`` (``$.a.b[0]``) as ``kind``; null if absent or of another kind."""
    return F.try_variant_get(F.col(document) if isinstance(document, str) else document, path, kind)


def with_fields(df: DataFrame, document: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with columns read from the document: name -> (path, type)."""
    return df.withColumns({name: field(document, path, kind) for name, (path, kind) in fields.items()})


def common_schema(df: DataFrame, document: str) -> str:
    """The narrowest schema that all documents fit, in one aggregation (a DDL text)."""
    return df.agg(F.schema_of_variant_agg(F.col(document)).alias("s")).first().s


def field_types(df: DataFrame, document: str, group_cols: Sequence[str] = (), depth: int = 4) -> DataFrame:
    """One row per (group, path, type) with the number of documents: which fields there are, and of what types.

    Objects are opened level by level down to ``depth``; an array counts as one value of its type. Every level is an
    explosion and all levels are counted in one aggregation that combines before the shuffle.
    """
    spark = df.sparkSession
    groups = [f"_g{i}" for i in range(len(group_cols))]
    level = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(group_cols, groups)], F.lit("$").alias("_path"),
                      F.col(f"`{document}`").alias("_doc"))
    out = None
    for _ in range(depth):
        objects = level.filter(F.schema_of_variant("_doc").startswith("OBJECT"))
        opened = objects.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer()))
        level = opened.select(*groups, F.concat("_path", F.lit("."), "key").alias("_path"), F.col("value").alias("_doc"))
        kind = F.regexp_replace(F.schema_of_variant("_doc"), r"[<(].*$", "")
        one = level.select(*groups, F.col("_path").alias("path"), kind.alias("type"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*groups, "path", "type").agg(F.count(F.lit(1)).alias("n")) \
        .select(*[F.col(k).alias(c) for k, c in zip(groups, group_cols)], "path", "type", "n")
