"""Calendar attributes of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.schemas import DAYS_PER_MONTH, DAYS_PER_YEAR


def months_in(days: Column) -> Column:
    return days.cast("double") / F.lit(DAYS_PER_MONTH)


def years_in(days: Column) -> Column:
    return days.cast("double") / F.lit(DAYS_PER_YEAR)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def weekday_number(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def days_seen_in_week(day: str) -> Column:
    """Distinct days of one week group, as an aggregate: one bit per weekday.

    Spares the row expansion that a second distinct count in the same group would cost.
    """
    return F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, weekday({day}))"))).cast("long")


def days_seen_in_month(day: str) -> Column:
    """Distinct days of one month group, as an aggregate: one bit per day of the month."""
    return F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, dayofmonth({day}))"))).cast("long")
