"""Correlations of hundreds of columns from masked Gram matrices.

``stats.corr_matrix`` writes one expression per pair, which ends at some tens of columns. Here every task
multiplies matrices: with X the batch's values (0 where missing) and M their mask, M'M counts the complete pairs of all
columns, X'M and (X^2)'M are the sums of one column over the rows that have the other, X'X the
products. A task keeps four c x c matrices per series, whatever its rows, and emits one row per
column; cells are added up in one aggregation.

Values are taken relative to one value of their column (of a few probed rows), so that sums of squares
keep their digits for columns far from zero; the choice does not change the result. A pair whose variance is zero, or lost
in rounding, has no correlation (rule D9).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows probed for a value of each column.
PROBE = 100
#: Series whose matrices a task holds at once; at more, it passes on what it has.
MOST_SERIES = 64
#: Variance below this share of the mean square counts as none.
NO_VARIANCE = 1e-13


def _origin(df: DataFrame, n: int) -> list[float]:
    out = [0.0] * n
    for row in df.limit(PROBE).collect():
        for i, v in enumerate(row["_x"]):
            if v is not None and v == v and abs(v) < float("inf") and out[i] == 0.0:
                out[i] = float(v)
    return out


def pair_sums(df: DataFrame, cols: Sequence[str], series_cols: Sequence[str] = (), listwise: bool = False) -> DataFrame:
    """(series, a, b, n, sa, sb, saa, sbb, sab) for every pair of column numbers, over rows that have both."""
    c = len(cols)
    keys = [f"k{i}" for i in range(len(series_cols))]
    x = F.array(*[F.nanvl(F.col(f"`{v}`").cast("double"), F.lit(None).cast("double")) for v in cols]).alias("_x")
    given = df.select(*[F.col(f"`{s}`").alias(k) for s, k in zip(series_cols, keys)], x)
    if listwise:
        given = given.filter(F.forall("_x", lambda v: v.isNotNull()))
    origin = np.array(_origin(given, c))
    types = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    fields = ["n", "s", "q", "p"]
    names = [*keys, "a", *fields]


    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, a, m) for k, m in held.items() for a in range(c)]
            cols_ = [pa.array([k[i] for k, _, _ in rows], schema.field(i).type) for i in range(len(keys))]
            cols_.append(pa.array([a for _, a, _ in rows], pa.int32()))
            cols_ += [pa.array([m[f][a].tolist() for _, a, m in rows], pa.list_(pa.float64())) for f in range(4)]
            return pa.RecordBatch.from_arrays(cols_, names=names)

        schema = None
        for b in batches:
            schema = b.schema
            if not b.num_rows:
                continue
            v = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c) - origin
            groups = [tuple(r) for r in zip(*[b.column(i).to_pylist() for i in range(len(keys))])] if keys else None
            where = {(): slice(None)} if not keys else {}
            if keys:
                for i, g in enumerate(groups):
                    where.setdefault(g, []).append(i)
            for g, at in where.items():
                part = v[at]
                has = ~np.isnan(part)
                part = np.where(has, part, 0.0)
                mask = has.astype(np.float64)
                new = [mask.T @ mask, part.T @ mask, (part * part).T @ mask, part.T @ part]
                old = held.get(g)
                held[g] = new if old is None else [p + q for p, q in zip(old, new)]
                if len(held) > MOST_SERIES:
                    yield out()
                    held.clear()
        if held:
            yield out()

    made = given.mapInArrow(add, ", ".join([*(f"{k} {types[k]}" for k in keys), "a int", *(f"{f} array<double>" for f in fields)]))
    cells = made.select(*keys, "a", F.posexplode(F.arrays_zip(*fields)).alias("b", "m")) \
        .groupBy(*keys, "a", "b").agg(*[F.sum(F.col("m")[f]).alias(f) for f in fields])
    # the sums of b over the pair's rows stand in the cell (b, a)
    l, r = cells.alias("l"), cells.alias("r")
    same = (F.col("l.a") == F.col("r.b")) & (F.col("l.b") == F.col("r.a"))
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return l.join(r, same).select(*[F.col(f"l.{k}").alias(s) for s, k in zip(series_cols, keys)], F.col("l.a").alias("a"),
                                  F.col("l.b").alias("b"), F.col("l.n").alias("n"), F.col("l.s").alias("sa"),
                                  F.col("r.s").alias("sb"), F.col("l.q").alias("saa"), F.col("r.q").alias("sbb"),
                                  F.col("l.p").alias("sab"))


def corr_wide(df: DataFrame, cols: Sequence[str], listwise: bool = False, series_cols: Sequence[str] = ()) -> DataFrame:
    """A17/A18 for any number of columns: (series, col_a, col_b, corr), as ``stats.corr_matrix``. A pair without correlation is null."""
    n = F.nullif(F.col("n"), F.lit(0.0))
    va, vb = F.col("saa") / n - (F.col("sa") / n) ** 2, F.col("sbb") / n - (F.col("sb") / n) ** 2
    cov = F.col("sab") / n - F.col("sa") / n * (F.col("sb") / n)
    good = (va > NO_VARIANCE * F.col("saa") / n) & (vb > NO_VARIANCE * F.col("sbb") / n)
    names = F.array(*[F.lit(c) for c in cols])
    sums = pair_sums(df, cols, series_cols, listwise)
    if not series_cols:
        # every pair has its row, also where no rows are left
        c = len(cols)
        grid = df.sparkSession.range(c * c).select((F.col("id") / c).cast("int").alias("a"), (F.col("id") % c).cast("int").alias("b"))
        sums = grid.join(sums, ["a", "b"], "left")
    return sums.select(
        *[F.col(f"`{s}`") for s in series_cols], F.element_at(names, F.col("a") + 1).alias("col_a"),
        F.element_at(names, F.col("b") + 1).alias("col_b"), F.when(good, cov / F.sqrt(va * vb)).alias("corr"))
