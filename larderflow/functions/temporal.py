"""Civil dates of a household: instants are read in its own zone, weeks begin on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this local hour on, the next dinner is tomorrow's.
DINNER_HOUR = 21


def local_date(at: Column, zone: Column) -> Column:
    """The civil date of an instant (session zone UTC) in an IANA zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_hour(at: Column, zone: Column) -> Column:
    return F.hour(F.from_utc_timestamp(at, zone))


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_sub(day, F.weekday(day))


def nights_of(monday: Column) -> Column:
    return F.sequence(monday, F.date_add(monday, 6))


def next_dinner(at: Column, zone: Column) -> Column:
    today = local_date(at, zone)
    return F.when(local_hour(at, zone) >= DINNER_HOUR, F.date_add(today, 1)).otherwise(today)


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")
