"""Quantiles and distinct counts kept over time as mergeable sketches.

Exact quantiles and distinct counts read every row again for each report. Here each day's rows are read once and
leave a row per (series, day): the count, a KLL sketch of every value column and an HLL sketch of every
counted column, some kilobytes however many rows the day had. Reports over any span of days merge sketches and read
nothing else.

A KLL sketch of size ``k`` answers with a rank that is off by at most ``rank_error(k)`` of the rows (with
99 % confidence, from the published analysis); merging keeps the bound. An HLL sketch with 2^lg registers has the
relative standard error ``distinct_error(lg)``.

Nulls and NaNs are left out of sketches (rule D1); a day without values has no sketch and adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch: about 0.9 % of the rows.
K = 400
#: Registers of an HLL sketch (2^12): about 1.6 % of the count.
LG = 12


def rank_error(k: int = K) -> float:
    """Normalised rank error of a quantile of a KLL sketch, one query."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2 ** lg)


def daily_sketches(df: DataFrame, *, ts: str, value_cols: Sequence[str] = (), distinct_cols: Sequence[str] = (),
                   series_cols: Sequence[str] = (), k: int = K, lg: int = LG) -> DataFrame:
    """(series, day, n, ``{column}_kll``, ``{column}_hll``) in one aggregation that combines before the shuffle."""
    values = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in value_cols}
    return df.groupBy(*[F.col(f"`{s}`") for s in series_cols], F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(x, F.lit(k)).alias(f"{c}_kll") for c, x in values.items()],
        *[F.hll_sketch_agg(F.col(f"`{c}`"), F.lit(lg)).alias(f"{c}_hll") for c in distinct_cols])


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the given rows (a span of days, all series, ...) as one per ``by``."""
    kll = [c for c in sketches.columns if c.endswith("_kll")]
    hll = [c for c in sketches.columns if c.endswith("_hll")]
    return sketches.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(f"`{c}`").alias(c) for c in kll],
        *[F.hll_union_agg(f"`{c}`").alias(c) for c in hll])


def quantile(column: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(f"`{column}_kll`"), F.lit(float(q)))


def distinct(column: str) -> Column:
    return F.hll_sketch_estimate(F.col(f"`{column}_hll`"))
