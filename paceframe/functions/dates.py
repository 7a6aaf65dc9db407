"""Dates, ISO weeks and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Sunday first.
WEEKDAYS_IT = ("Dom", "Lun", "Mar", "Mer", "Gio", "Ven", "Sab")


def iso_week_id(day: Column) -> Column:
    """ISO year and week as ``IYYY-IW``."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat_ws("-", year, F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def iso_week_monday(week_id: Column) -> Column:
    """Monday of an ``IYYY-IW`` week: the week of 4 January is always week 1."""
    year = F.split_part(week_id, F.lit("-"), F.lit(1)).cast("int")
    week = F.split_part(week_id, F.lit("-"), F.lit(2)).cast("int")
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.date_add(first_monday, (week - 1) * 7)


def weekday_number(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def weekday_name(number: Column) -> Column:
    """Italian short name of a weekday number."""
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS_IT]), number + 1)


def month_number(ts: Column) -> Column:
    """Year and month as one number, the partition key of the analytical tables."""
    return F.date_format(ts, "yyyyMM").cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole calendar days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier)


def parse_iso(x: Column) -> Column:
    """ISO-8601 text to timestamp, NULL when it is not one."""
    return F.try_to_timestamp(x)
