"""Column expressions and the fixed values they use."""

from . import values
from .exprs import (alert_class, calendar_parts, cyclic, day_str, flag_to_int, gauge_class,
                    index_label, larger_of, level3, level4, level4_advice, level_max,
                    local_time, month_label, month_str, nan_to_null, null_safe_corr,
                    numeric_columns, rain_class, range_text, range_violation, rounded,
                    safe_div, safe_ratio, season, weekday, with_unit)

__all__ = [
    "values", "alert_class", "calendar_parts", "cyclic", "day_str", "flag_to_int",
    "gauge_class", "index_label", "larger_of", "level3", "level4", "level4_advice",
    "level_max", "local_time", "month_label", "month_str", "nan_to_null", "null_safe_corr",
    "numeric_columns", "rain_class", "range_text", "range_violation", "rounded", "safe_div",
    "safe_ratio", "season", "weekday", "with_unit",
]
