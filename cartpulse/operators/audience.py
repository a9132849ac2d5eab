"""First-seen dates, new and cumulative counts per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.functions.dates import day


def first_seen(actions: DataFrame, key: str, name: str = "start_date") -> DataFrame:
    """First action date per ``key`` (S7): ``key``, ``name``.

    An aggregation, not a window over the log: partial aggregation collapses
    a hot user or courier on the map side before the shuffle.
    """
    return actions.groupBy(key).agg(F.min(day("time")).alias(name))


def new_per_day(first: DataFrame, key: str, count_name: str, date_col: str = "start_date") -> DataFrame:
    """Number of ids whose first date is each date: date, ``count_name``.

    Null ids are not counted (a null id never matches an equi-join back to
    the log in the original formulation).
    """
    return (
        first.filter(F.col(key).isNotNull())
        .groupBy(F.col(date_col).alias("date"))
        .agg(F.count(F.lit(1)).alias(count_name))
    )


def day_order() -> Window:
    """Window over day-level rows ordered by date, nulls last (SQL default order).

    It has no partition: it is only ever applied to one row per calendar
    day, a few thousand rows even for years of data.
    """
    return Window.orderBy(F.col("date").asc_nulls_last())


def running_sum(col: str | Column) -> Column:
    """Running total over dates with the SQL default frame (RANGE ... CURRENT ROW)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).over(day_order())
