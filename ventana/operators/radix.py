"""Exact quantiles of many columns and groups at once by radix selection.

``percentile`` keeps a group's distinct values in one buffer. Here every wanted rank of every (group, column) has an
interval of values that holds it, first from the column's least to its largest value. A round cuts
all intervals into ``DIGITS`` equal parts, counts the rows (with least and largest value) of each part in one hash
aggregation, which combines before the shuffle, and keeps the part that holds the rank, shrunk to the values
in it. An interval of one value is done. What is shuffled is at most ``DIGITS`` rows per interval and task, so a group
with half of all rows costs its share of the scan and no more.

After the first round only rows inside the remaining intervals are written and read again, about one in
``DIGITS`` for each rank. The ends of an interval always fall into different parts, so every round makes progress; for
values spread over many orders of magnitude it takes more rounds.

Nulls and NaNs are left out (rule D1); a group without values has no row; null groups are a group. Positions are
interpolated linearly, as ``percentile`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path

#: Parts into which an interval is cut in a round.
DIGITS = 4096
#: More rounds than any set of doubles needs.
MOST_ROUNDS = 400


class _Stored:
    """A written intermediate table: bounded by the ranks, or by the rows between them."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, "radix")
        df.write.mode("overwrite").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a table whose size Spark knows."""
    return _Stored(df).df


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return out


def _inside(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the interval they lie in; intervals of a key do not overlap."""
    r, i = rows.alias("r"), intervals.alias("i")
    hit = _same("r", "i", keys) & (F.col("r._v") >= F.col("i._lo")) & (F.col("r._v") <= F.col("i._hi"))
    return r.join(i, hit).select(*[F.col(f"r.`{k}`").alias(k) for k in keys], "r._v", "i._lo", "i._hi")


def _cut(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of the intervals that hold their ranks, as the next intervals."""
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    wide = hi - lo == F.lit(float("inf"))
    share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
    part = F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1)).alias("_part")
    cells = _inside(rows, intervals, keys).select(*[f"`{k}`" for k in keys], "_lo", "_v", part) \
        .groupBy(*[f"`{k}`" for k in keys], "_lo", "_part") \
        .agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    before = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_lo").orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("_sofar", F.coalesce(F.sum("_k").over(before), F.lit(0))).alias("c")
    i = intervals.alias("i")
    start = F.col("i._below") + F.col("c._sofar")
    met = c.join(i, _same("c", "i", keys) & (F.col("c._lo") == F.col("i._lo"))).select(
        *[F.col(f"c.`{k}`").alias(k) for k in keys], F.col("c._a").alias("_lo"), F.col("c._b").alias("_hi"),
        start.alias("_below"), F.filter("i._ranks", lambda r: (r >= start) & (r < start + F.col("c._k"))).alias("_ranks"))
    return met.filter(F.size("_ranks") > 0)


def quantiles_long(df: DataFrame, value_cols: Sequence[str], probs: Sequence[float],
                   group_cols: Sequence[str] = (), column: str = "column") -> DataFrame:
    """One row per (group, column) that has values: group columns, ``column``, ``n`` and q0, q1, ... for ``probs``."""
    g = list(group_cols)
    keys = [*g, column]
    pairs = F.array(*[F.struct(F.lit(c).alias(column), F.col(f"`{c}`").cast("double").alias("_v")) for c in value_cols])
    rows = df.select(*[F.col(f"`{k}`") for k in g], F.inline(pairs)).filter("_v is not null and not isnan(_v)")
    quoted = [f"`{k}`" for k in keys]
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(a), F.ceil(a)) for a in at]))
    ends = _Stored(rows.groupBy(*quoted).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
                   .withColumn("_below", F.lit(0).cast("long")).withColumn("_ranks", ranks))
    fields = [*quoted, "_lo", "_hi", "_below", "_ranks"]
    found = ends.df.filter("_lo = _hi").select(*fields)
    now = ends.df.filter("_lo < _hi").select(*fields)
    source: _Stored | None = None
    for _ in range(MOST_ROUNDS):
        if now.isEmpty():
            break
        following = _Stored(_cut(rows, now, keys))        # bounded by the ranks; kept until the end
        found = found.unionByName(following.df.filter("_lo = _hi"))
        now = following.df.filter("_lo < _hi")
        if now.isEmpty():
            break
        # rows that no interval holds are not read again
        less = _Stored(_inside(rows, now, keys).select(*quoted, "_v"))
        if source is not None:
            source.drop()
        source, rows = less, less.df
    else:
        raise RuntimeError("quantiles: values did not separate")
    if source is not None:
        source.drop()
    values = found.select(*quoted, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v")).groupBy(*quoted).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))     # two ranks a probability
    e, q = ends.df.select(*quoted, "n").alias("e"), values.alias("q")
    out = []
    for i, a in enumerate(at):
        low, high = F.element_at("_at", F.floor(a)), F.element_at("_at", F.ceil(a))
        out.append(F.when(low == high, low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high).alias(f"q{i}"))
    one = e.join(q, _same("e", "q", keys)).select(*[F.col(f"e.`{k}`").alias(k) for k in keys], "n", "_at")
    return one.select(*quoted, "n", *out)


def quantiles_wide(df: DataFrame, value_cols: Sequence[str], probs: dict[str, float],
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group (one row without groups, also of an empty table), ``{column}_{name}`` for every column and name of ``probs``."""
    g = [f"`{k}`" for k in group_cols]
    names = list(probs)
    long = quantiles_long(df, value_cols, [probs[n] for n in names], group_cols, column="_column")
    cells = [F.max(F.when(F.col("_column") == c, F.col(f"q{i}"))).alias(f"{c}_{n}")
             for c in value_cols for i, n in enumerate(names)]
    found = long.groupBy(*g).agg(*cells)
    if not g:
        return found
    # groups without a single value keep their row
    every = df.select(*g).distinct().alias("a")
    f = found.alias("f")
    return every.join(f, _same("a", "f", group_cols), "left").select("a.*", *[F.col(f"f.`{c}_{n}`") for c in value_cols for n in names])
