"""Repeatable samples and previews (L3, L4).

A sample ordered by a hash of (seed, key) is the same on every run and in every
engine; ``limit(n)`` on that order is a top-n (TakeOrderedAndProject keeps n
rows per task, then n overall), so memory is bounded by n, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_key(key_cols: Sequence[str], seed: int = 42):
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in key_cols]
    return F.md5(F.concat_ws("-", *parts))


def hashed_sample(df: DataFrame, key_cols: Sequence[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """L4: min(n, rows) rows chosen by hash order of the key (seeded)."""
    return df.orderBy(hash_key(key_cols, seed), *key_cols).limit(n)


def top_n(df: DataFrame, order_col: str, n: int, *tiebreak: str) -> DataFrame:
    """L3: the n largest rows by a column (ties broken by the given keys)."""
    return df.orderBy(F.desc(order_col), *tiebreak).limit(n)
