"""Column-level helpers: exact rounding, calendar functions."""

from cartpulse.functions.dates import (
    day,
    days_between,
    hour_of,
    iso_weekday,
    micros_between,
    month_start,
    weekday_name,
)
from cartpulse.functions.numeric import (
    half_up_div,
    half_up_div_sql,
    money_pct,
    money_ratio,
    pct,
    round_div,
    round_div_sql,
    units_sql,
    with_scale,
    with_scale_sql,
)

__all__ = [
    "day",
    "days_between",
    "half_up_div",
    "half_up_div_sql",
    "hour_of",
    "iso_weekday",
    "micros_between",
    "money_pct",
    "money_ratio",
    "month_start",
    "pct",
    "round_div",
    "round_div_sql",
    "units_sql",
    "weekday_name",
    "with_scale",
    "with_scale_sql",
]
