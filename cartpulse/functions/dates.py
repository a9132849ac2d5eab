"""Calendar helpers on TIMESTAMP_NTZ / DATE columns (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(ts: Column | str) -> Column:
    """Calendar date of a timestamp (``time::date``)."""
    return F.to_date(col_of(ts))


def hour_of(ts: Column | str) -> Column:
    """Hour 0-23 of a timestamp, as INT."""
    return F.hour(col_of(ts)).cast("int")


def iso_weekday(ts: Column | str) -> Column:
    """ISO day of week, Monday = 1 ... Sunday = 7, as INT."""
    return (F.weekday(col_of(ts)) + 1).cast("int")


def weekday_name(ts: Column | str) -> Column:
    """English weekday name blank-padded to 9 characters ('Monday   ').

    This is the output of the SQL ``to_char(x, 'Day')`` template.
    """
    return F.rpad(F.date_format(col_of(ts), "EEEE"), 9, " ")


def month_start(d: Column | str) -> Column:
    """First day of the month of a date."""
    return F.trunc(col_of(d), "month")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """``later - earlier`` in whole days, as INT."""
    return F.datediff(col_of(later), col_of(earlier)).cast("int")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds (BIGINT); exact for sub-second times."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))
