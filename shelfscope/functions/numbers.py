"""Arithmetic where a zero divisor gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_column(part).cast("double"), _column(whole).cast("double"))


def change(now: Column | str, before: Column | str) -> Column:
    return _column(now) - _column(before)


def change_rate(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - F.lit(1.0)


def money_sum(price: Column | str = "price") -> Column:
    """Exact decimal total as a double; no rows give 0, and row order has no effect."""
    return F.coalesce(F.sum(price), F.lit(0)).cast("double")


def rows() -> Column:
    return F.count(F.lit(1))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
