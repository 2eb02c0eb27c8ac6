"""Schema-level column operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.exprs import numeric_columns


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (or in any column)."""
    return df.dropna(subset=list(subset)) if subset else df.dropna()


def drop_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*[n for n in names if n in df.columns])


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns that the frame lacks (schema only)."""
    have = set(df.columns)
    return [c for c in expected if c not in have]


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
                   dtype: str = "double") -> DataFrame:
    """Add missing features as NULL and put them in the given order."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(None).cast(dtype).alias(c)
                              for c in features])


def complete_rows(df: DataFrame, features: Sequence[str], raise_on_null: bool = False) -> DataFrame:
    """Keep rows whose features are all present; or fail on the first
    incomplete row (``raise_error`` runs inside the job, no collect)."""
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull()
    if raise_on_null:
        # a filter condition is evaluated for every row (a dropped helper column
        # would be pruned by the optimizer and never raise)
        return df.filter(F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("row with missing features"))))
    return df.filter(ok)


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep only numeric columns (plus ``keep``)."""
    return df.select(*keep, *numeric_columns(df, exclude=keep))


def with_coordinates(df: DataFrame, lat: float = V.STATION_LAT, lon: float = V.STATION_LON) -> DataFrame:
    """P20: add constant station coordinates when the frame has none."""
    if "lat" in df.columns:
        return df
    return df.withColumns({"lat": F.lit(lat), "lon": F.lit(lon)})


def short_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename measures to their short labels (absent ones ignored)."""
    names = V.SHORT_NAMES if names is None else names
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
