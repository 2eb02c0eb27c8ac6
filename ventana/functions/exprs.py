"""Column expressions (all JVM-side, no Python UDFs).

Every helper returns a ``Column`` so it composes inside ``select``/``agg`` and
stays within whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- scan hygiene -------------------------------------------------------------

def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Rule D1: NaN means missing. Turn NaN into NULL once, at scan time."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols if cols is not None else floating) if c in floating]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """The numeric columns of a frame, in schema order."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


# --- calendar -------------------------------------------------------------------

def weekday(ts: ColumnOrName) -> Column:
    """Rule D2: Monday = 0."""
    return F.weekday(col(ts))


def day_str(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def month_str(ts: ColumnOrName) -> Column:
    """'Sep 2025' style label."""
    return F.date_format(col(ts), "MMM yyyy")


def calendar_parts(df: DataFrame, ts: str = "date") -> DataFrame:
    """Hour, month, weekday (Mon=0), day text and month text."""
    return df.withColumns({
        "hour": F.hour(ts),
        "month": F.month(ts),
        "dayofweek": weekday(ts),
        "date_str": day_str(ts),
        "month_str": month_str(ts),
    })


def local_time(ts: ColumnOrName, tz: str = V.STATION_TZ) -> Column:
    """Wall clock of a UTC timestamp in a named zone."""
    return F.from_utc_timestamp(col(ts).cast("timestamp"), tz)


def cyclic(c: ColumnOrName, period: float = 24.0) -> tuple[Column, Column]:
    """P10: sin/cos encoding of a periodic value."""
    angle = F.lit(2.0 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month: ColumnOrName) -> Column:
    """Dry season in Dec-Feb, wet otherwise (NULL month counts as wet)."""
    return F.when(col(month).isin(*V.DRY_MONTHS), V.SEASON_DRY).otherwise(V.SEASON_WET)


def month_label(month: ColumnOrName, labels: dict[int, str] | None = None) -> Column:
    """Dictionary lookup, unmapped months give NULL."""
    labels = V.MONTH_LABELS if labels is None else labels
    pairs = []
    for k, v in labels.items():
        pairs += [F.lit(int(k)), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col(month).cast("int"))


# --- arithmetic -------------------------------------------------------------------

def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Rule D8: a / b with zero divisors giving NULL (ANSI-safe)."""
    return col(a) / F.nullif(col(b), F.lit(0))


def safe_ratio(a: ColumnOrName, b: ColumnOrName, digits: int | None = None) -> Column:
    """A / b, NULL when b is 0, optionally rounded."""
    r = safe_div(a, b)
    return F.round(r, digits) if digits is not None else r


def rounded(c: ColumnOrName, digits: int | None) -> Column:
    """Round to ``digits`` (half up, see rule D5); ``None`` keeps full precision.

    Six more digits are rounded first: a mean that lies on a tie would otherwise go up or down
    with the order in which its rows were summed.
    """
    return col(c) if digits is None else F.round(F.round(col(c), digits + 6), digits)


def null_safe_corr(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Rule D9: Pearson correlation over complete pairs, NULL for a constant column.

    Spark's ``corr`` raises under ANSI when a column is constant; this form gives
    NULL instead and equals ``corr`` otherwise.
    """
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    sa = F.stddev_pop(F.when(both, a))
    sb = F.stddev_pop(F.when(both, b))
    return F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0))


def range_violation(c: ColumnOrName, lo: float = V.PM25_RANGE[0],
                    hi: float = V.PM25_RANGE[1]) -> Column:
    """Value outside [lo, hi] (NULL is not a violation)."""
    return F.coalesce((col(c) < lo) | (col(c) > hi), F.lit(False))


# --- labels ------------------------------------------------------------------------

def _bounded_label(x: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """``x <= bounds[i]`` picks ``labels[i]``; NULL and the rest get the last label."""
    expr = None
    for b, lab in zip(bounds, labels):
        expr = F.when(x <= b, lab) if expr is None else expr.when(x <= b, lab)
    return expr.otherwise(labels[-1])


def level3(x: ColumnOrName) -> Column:
    """P5: <=12, <=35.5, else (NULL falls to the worst label)."""
    return _bounded_label(col(x), V.LEVEL3_BOUNDS, V.LEVEL3_LABELS)


def level4(x: ColumnOrName) -> Column:
    """Label with <=12, <=35, <=55, else."""
    return _bounded_label(col(x), V.LEVEL4_BOUNDS, V.LEVEL4_LABELS)


def level4_advice(x: ColumnOrName) -> Column:
    """The advice text that goes with ``level4``."""
    return _bounded_label(col(x), V.LEVEL4_BOUNDS, V.LEVEL4_ADVICE)


def larger_of(first: ColumnOrName, second: ColumnOrName) -> Column:
    """Rule D7: Python ``max(first, second)`` on floats with NaN.

    NULL first -> NULL; NULL second -> first; else the larger one.
    """
    a, b = col(first), col(second)
    return F.when(a.isNull(), F.lit(None).cast("double")) \
        .when(b > a, b).otherwise(a)


def level_max(pm10: ColumnOrName, pm25: ColumnOrName) -> Column:
    """Label of ``max(pm10, pm2_5)`` with the D7 null rule."""
    return _bounded_label(larger_of(pm10, pm25), V.LEVEL_MAX_BOUNDS, V.LEVEL_MAX_LABELS)


def index_label(x: ColumnOrName) -> Column:
    """Label of a mean index: <=50, <=100, else."""
    return _bounded_label(col(x), V.INDEX_BOUNDS, V.INDEX_LABELS)


def rain_class(x: ColumnOrName) -> Column:
    """Intensity class of a rain amount: <1, <3, else."""
    x = col(x)
    return F.when(x < V.RAIN_BOUNDS[0], V.RAIN_CLASSES[0]) \
        .when(x < V.RAIN_BOUNDS[1], V.RAIN_CLASSES[1]).otherwise(V.RAIN_CLASSES[2])


def flag_to_int(c: ColumnOrName) -> Column:
    """Missing flag -> 0, as integer."""
    return F.coalesce(col(c).cast("int"), F.lit(0))


def alert_class(text: ColumnOrName) -> Column:
    """Substring test of a label text, first rule wins, else NULL."""
    t = col(text)
    expr = None
    for needle, cls in V.ALERT_RULES:
        cond = F.coalesce(t.contains(needle), F.lit(False))
        expr = F.when(cond, cls) if expr is None else expr.when(cond, cls)
    return expr


def gauge_class(value: ColumnOrName, limit: ColumnOrName) -> Column:
    """Colour class of value/limit: >1 danger, >0.75 amber, else teal."""
    r = safe_div(value, limit)
    return F.when(r > V.GAUGE_RATIO_BOUNDS[0], V.GAUGE_CLASSES[0]) \
        .when(r > V.GAUGE_RATIO_BOUNDS[1], V.GAUGE_CLASSES[1]).otherwise(V.GAUGE_CLASSES[2])


def with_unit(value: ColumnOrName, digits: int = 2, unit: str = V.UNIT) -> Column:
    """KPI text such as '2.31 μg/m³' (NULL stays NULL).

    ``format_number`` rounds the binary value half-even, as Python's
    ``f"{x:.2f}"`` does (``format_string`` rounds the decimal text instead:
    26.845 -> '26.85' where Python prints '26.84'); grouping commas are removed.
    """
    v = col(value)
    return F.concat(F.translate(F.format_number(v, digits), ",", ""), F.lit(f" {unit}"))


def range_text(lo: ColumnOrName, hi: ColumnOrName) -> Column:
    """P22: 'a → b'."""
    return F.concat_ws(" → ", col(lo), col(hi))
