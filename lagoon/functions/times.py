"""Dates, durations and calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")


def seconds(start: Column, stop: Column) -> Column:
    """Seconds between two timestamps without zone as a double, from their fields: the session's time
    zone has no say."""
    return F.datediff(F.to_date(stop), F.to_date(start)) * F.lit(86400.0) + (_of_day(stop) - _of_day(start))


def days(start: Column, stop: Column) -> Column:
    """The days from ``start`` to ``stop``, both included."""
    return F.sequence(F.to_date(start), F.to_date(stop))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_of_month(date: Column) -> Column:
    return F.day(F.last_day(date))


def days_of_year(year: Column) -> Column:
    return F.when(is_leap(year), 366).otherwise(365)


def hour_number(time: Column, origin: str) -> Column:
    """Whole hours since ``origin``, a full hour."""
    day, hour = origin.split(" ")
    return (F.datediff(F.to_date(time), F.lit(day).cast("date")) * 24 + F.hour(time) - int(hour.split(":")[0])).cast("int")
