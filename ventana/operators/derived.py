"""Windows framed by time, circular means, and the weather features made with them.

The other windows count rows (rule D15): the row three back is three hours ago only where no hour is missing. Here frames
are spans of time, so a gap gives a null instead of an older value.

A series is cut into slices of time; rows near a slice's end are copied into the next one, and every window runs per
(series, slice). Slices are fixed spans, so no count or sample is needed, one exchange deals the rows out, and a
series that holds a third of all rows lies in as many tasks as it has slices. Results equal those of a
window over the whole series.

Defined cases: rows without a time have null results; several readings at the time looked for count as their mean;
a mean without readings is null; the mean direction of winds that cancel out is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..sources.store import free_name

HOUR = 3600
DAY = 24 * HOUR
MICROS = 1_000_000
#: Least span of a slice; a slice is also at least ``SLICE_FACTOR`` times the reach of the frames.
SLICE_SECONDS = 30 * DAY
SLICE_FACTOR = 4
#: Length of a mean direction (0 to 1) below which it has none.
NO_DIRECTION = 1e-9


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01")))
    seconds = (F.extract(F.lit("SECOND"), c) * MICROS).cast("long")
    return days.cast("long") * (DAY * MICROS) + (F.hour(c) * HOUR + F.minute(c) * 60).cast("long") * MICROS + seconds


class TimeFrames:
    """Frames of a window ordered by time: spans in seconds around the row."""

    def __init__(self, window: Window):
        self.window = window

    def between(self, start: float, end: float) -> Window:
        return self.window.rangeBetween(round(start * MICROS), round(end * MICROS))

    def value_before(self, col: str | Column, seconds: float) -> Column:
        """The value exactly ``seconds`` earlier (null where there is none)."""
        return F.avg(col).over(self.between(-seconds, -seconds))

    def change(self, col: str, seconds: float) -> Column:
        return F.col(col) - self.value_before(col, seconds)

    def mean(self, col: str | Column, seconds: float, min_values: int = 1) -> Column:
        """Mean of the last ``seconds`` (the row included, the reading at the far end not)."""
        frame = self.window.rangeBetween(1 - round(seconds * MICROS), 0)
        return F.when(F.count(col).over(frame) >= min_values, F.avg(col).over(frame))

    def mean_direction(self, degrees: str, seconds: float, weight: str | None = None) -> Column:
        frame = self.window.rangeBetween(1 - round(seconds * MICROS), 0)
        return mean_direction(degrees, weight, lambda c: c.over(frame))


def mean_direction(degrees: str, weight: str | None = None, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Circular mean in degrees [0, 360) of directions, weighted by e.g. the wind speed; an aggregation, or a window
    function with ``over``. Rows that lack direction or weight do not count."""
    x, y, w = _parts(degrees, weight)
    length = F.hypot(over(F.avg(x)), over(F.avg(y)))
    return F.when(safe_div(length, over(F.avg(F.abs(w)))) > NO_DIRECTION,
                  F.pmod(F.degrees(F.atan2(over(F.avg(y)), over(F.avg(x)))), F.lit(360.0)))


def steadiness(degrees: str, weight: str | None = None, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Length of the mean direction: 1 for one direction throughout, 0 for winds that cancel out."""
    x, y, w = _parts(degrees, weight)
    return safe_div(F.hypot(over(F.avg(x)), over(F.avg(y))), over(F.avg(F.abs(w))))


def _parts(degrees: str, weight: str | None) -> tuple[Column, Column, Column]:
    angle = F.radians(F.col(degrees).cast("double"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when(angle.isNotNull(), w)
    return w * F.cos(angle), w * F.sin(angle), w


def with_time_frames(df: DataFrame, *, ts: str, build: Callable[[TimeFrames], dict[str, Column]], back: float,
                     ahead: float = 0, series_cols: Sequence[str] = (), slice_seconds: float | None = None) -> DataFrame:
    """``df`` with the columns that ``build`` makes of time frames reaching at most ``back`` and ``ahead`` seconds."""
    wanted = slice_seconds or max(SLICE_SECONDS, SLICE_FACTOR * (back + ahead))
    span = round(max(wanted, back + ahead, 1) * MICROS)       # frames reach no further than the neighbouring slice
    at, own, held = (free_name(df, n) for n in ("_at", "_own", "_slice"))
    t, s = F.col(at), F.col(own)
    # a row also serves the next slice (looking back) or the one before (looking ahead)
    copies = F.array_compact(F.array(
        s, F.when(t >= (s + 1) * span - round(back * MICROS), s + 1), F.when(t < s * span + round(ahead * MICROS), s - 1)))
    # rows without a time are dealt anywhere: no frame looks at them
    anywhere = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    dealt = df.withColumn(at, micros(ts)).withColumn(own, F.coalesce(F.floor(t / span), anywhere)) \
        .withColumn(held, F.explode(copies))
    frames = TimeFrames(Window.partitionBy(*[F.col(f"`{c}`") for c in series_cols], F.col(held)).orderBy(t))
    made = {k: F.when(t.isNotNull(), c) for k, c in build(frames).items()}
    return dealt.withColumns(made).filter(F.col(held) == F.col(own)).drop(at, own, held)


def derived_weather(df: DataFrame, *, ts: str = "date", series_cols: Sequence[str] = (),
                    temperature: str = "temperature_2m", apparent: str = "apparent_temperature",
                    humidity: str = "relative_humidity_2m", pressure: str = "surface_pressure",
                    direction: str = "wind_direction_10m", speed: str | None = "wind_speed_10m", ozone: str = "ozone",
                    slice_seconds: float | None = None) -> DataFrame:
    """The features that the dashboards advise, as far as their inputs are there.

    apparent_gap (apparent minus air temperature), temp_humidity (product), wind_sin and wind_cos,
    pressure_change_3h and ozone_lag_6h (by the clock), humidity_mean_7d, and the mean wind direction of six hours.
    """
    has = set(df.columns)
    plain: dict[str, Column] = {}
    if {temperature, apparent} <= has:
        plain["apparent_gap"] = F.col(apparent) - F.col(temperature)
    if {temperature, humidity} <= has:
        plain["temp_humidity"] = F.col(temperature) * F.col(humidity)
    if direction in has:
        angle = F.col(direction) * F.lit(math.pi / 180)
        plain.update(wind_sin=F.sin(angle), wind_cos=F.cos(angle))

    def build(w: TimeFrames) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if pressure in has:
            out["pressure_change_3h"] = w.change(pressure, 3 * HOUR)
        if ozone in has:
            out["ozone_lag_6h"] = w.value_before(ozone, 6 * HOUR)
        if humidity in has:
            out["humidity_mean_7d"] = w.mean(humidity, 7 * DAY)
        if direction in has:
            out["wind_mean_6h"] = w.mean_direction(direction, 6 * HOUR, speed if speed in has else None)
        return out

    return with_time_frames(df.withColumns(plain) if plain else df, ts=ts, build=build, back=7 * DAY, series_cols=series_cols,
                            slice_seconds=slice_seconds)
