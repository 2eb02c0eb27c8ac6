"""Helpers shared by the operators: written intermediate tables, shared per-worker
state, training splits and connected components."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_path, scratch_path

#: Rows in an Arrow batch: a batch of whole texts must fit a Python worker many times over.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small (session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Table:
    """A DataFrame written as Parquet below the shared folder and read back.

    A lost executor costs a re-read, never the work above the table; ``drop``
    removes the files once a later table has replaced them.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = scratch_path(spark, f"llm-{name}")
        df.write.mode("overwrite").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.df.sparkSession, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def shared(spark: SparkSession, settings: dict[str, Any]):
    """Broadcast a plain dict; a worker keeps what it derives from it in the same dict.

    Python workers hold one copy of a broadcast value for their whole life, so
    tables built from it (``once``) are built once a worker, not once a task.
    """
    return spark.sparkContext.broadcast(dict(settings))


def once(state: dict, key: str, build: Callable[[], Any]) -> Any:
    if key not in state:
        state[key] = build()
    return state[key]


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(rows: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: inside, columns are called by their numbers."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(fn, plain).toDF(*schema.names)


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % n


def held_out(id_col: str | Column, n: int = 5) -> Column:
    """Rows kept out of learning: crc32(id) mod n = 0 (a null id counts as held out)."""
    return F.coalesce(remainder(id_col, n) == 0, F.lit(True))


def bounded_sample(rows: DataFrame, id_col: str, bound: int, salt: str = "sample") -> DataFrame:
    """About ``bound`` rows drawn by a hash of the id; all rows if there are no more. Another ``salt`` draws others.

    ``bound`` is a documented parameter of the operators that learn from labelled rows.
    """
    n = rows.count()
    if n <= bound:
        return rows
    cut = int(bound / n * (1 << 31))
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 31)) < cut)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: one row (node, component) per node that
    has an edge, ``component`` being the smallest node it can reach.

    Alternates two rewrites of the edge list until it is a set of stars: every larger
    neighbour of a node is tied to the node's smallest neighbour, then every smaller one.
    The rounds grow with the logarithm of the longest chain. A node's minimum is an
    aggregation that combines before the shuffle and is joined back, so a node with very many
    neighbours is never gathered in one task. Each round's edges are written to the shared
    folder and replace the ones before. Self loops and null ends are ignored.
    """
    spark = edges.sparkSession
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .filter("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = Table(e, "edges")
    state = _fingerprint(now.df)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").filter("u <> v").distinct()
        nxt = Table(small, "edges")
        seen, state = state, _fingerprint(nxt.df)
        now.drop()
        now = nxt
        if seen == state:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return (now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _fingerprint(e: DataFrame) -> tuple:
    """Number of distinct edges and exclusive ors of their hashes, which no number of them overflows."""
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


__all__ = ["BATCH_ROWS", "Table", "bound_batches", "bounded_sample", "components",
           "free", "hamming", "held_out", "map_arrow", "once", "quoted", "remainder", "shared", "text_or_empty", "written"]
