"""Calendar columns that take the day of reference as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_since(c: Column, as_of: Column) -> Column:
    return F.datediff(as_of, F.to_date(c))


def years_of_service(c: Column, as_of: Column) -> Column:
    """Completed years of 365.25 days."""
    return F.floor(days_since(c, as_of) / 365.25).cast("long")


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def next_monthly(day: Column, as_of: Column) -> Column:
    """The next date with this day of the month (the month's last day if it is shorter), today included."""

    def in_month(first: Column) -> Column:
        return F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)

    this = in_month(F.trunc(as_of, "month"))
    return F.when(this >= as_of, this).otherwise(in_month(F.add_months(F.trunc(as_of, "month"), 1)))


def milestone(days: Column, windows: list[tuple[int, int, str]]) -> Column:
    """The name of the window (first day, last day, name) that holds ``days``."""
    out = F.lit(None).cast("string")
    for first, last, name in reversed(windows):
        out = F.when(days.between(first, last), name).otherwise(out)
    return out


def serial_to_timestamp(serial: Column, epoch_1904: bool = False) -> Column:
    """A spreadsheet's day number as a timestamp, to the millisecond."""
    epoch = -2082844800000 if epoch_1904 else -2209161600000
    return F.timestamp_millis((F.lit(epoch) + F.round(serial * 86400000)).cast("long"))
