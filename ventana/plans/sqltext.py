"""Small builders for the DuckDB oracle text (window idioms written once)."""

from __future__ import annotations

from collections.abc import Sequence

from .registry import SQL_DAY_FMT, SQL_TS_FMT


def rnd(x: str, digits: int) -> str:
    """Half-up rounding without summation noise, as ``functions.exprs.rounded``."""
    more = digits + 6
    return f"CAST(round(CAST(round({x}, {more}) AS DECIMAL(32, {more})), {digits}) AS DOUBLE)"


def ts_txt(c: str) -> str:
    return f"strftime({c}, '{SQL_TS_FMT}')"


def day_txt(c: str) -> str:
    return f"strftime({c}, '{SQL_DAY_FMT}')"


def part(series: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(series)} " if series else ""


def win(series: Sequence[str], order: str, frame: str = "") -> str:
    return f"OVER ({part(series)}ORDER BY {order}{(' ' + frame) if frame else ''})"


def rolling_mean(c: str, series: Sequence[str], order: str, n: int, min_periods: int | None = None,
                 shift: int = 0) -> str:
    need = n if min_periods is None else min_periods
    lo, hi = n - 1 + shift, shift
    hi_txt = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    w = win(series, order, f"ROWS BETWEEN {lo} PRECEDING AND {hi_txt}")
    return f"CASE WHEN count({c}) {w} >= {need} THEN avg({c}) {w} END"


def interp_select(cols: Sequence[str], series: Sequence[str], order: str, src: str,
                  keep: Sequence[str]) -> str:
    """SELECT applying positional linear interpolation to ``cols`` of ``src``."""
    back = win(series, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    fwd = win(series, order, "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    inner = [f"*, row_number() {win(series, order)} AS _pos"]
    body = []
    for c in cols:
        inner.append(f"last_value({c} IGNORE NULLS) {back} AS _pv_{c}")
        inner.append(f"last_value(CASE WHEN {c} IS NOT NULL THEN _p END IGNORE NULLS) {back} AS _pp_{c}")
        inner.append(f"first_value({c} IGNORE NULLS) {fwd} AS _nv_{c}")
        inner.append(f"first_value(CASE WHEN {c} IS NOT NULL THEN _p END IGNORE NULLS) {fwd} AS _np_{c}")
        body.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN _pv_{c} IS NULL THEN NULL "
            f"WHEN _nv_{c} IS NULL THEN _pv_{c} "
            f"ELSE _pv_{c} + (_nv_{c} - _pv_{c}) * (_pos - _pp_{c}) / (_np_{c} - _pp_{c}) END AS {c}")
    numbered = f"(SELECT *, row_number() {win(series, order)} AS _p FROM {src})"
    return (f"SELECT {', '.join(keep)}, {', '.join(body)} FROM (SELECT "
            f"{', '.join(inner)} FROM {numbered})")


def corr(a: str, b: str) -> str:
    """Null-safe correlation (NULL for a constant column), same formula as Spark side."""
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {both} THEN {a} END) * "
            f"stddev_pop(CASE WHEN {both} THEN {b} END), 0)")
