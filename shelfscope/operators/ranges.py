"""Order over any number of rows: range partitions of about equal size, and counts before each.

A window over a whole group, or over the whole table, puts it into one task. Here the rows are cut into
ranges of the ordering columns, as many as their number asks for; a range is ordered by itself, and
only the ranges' totals, one row for each range and group, tell what lies before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.sources.kept import checkpointed

Keep = Callable[[DataFrame], DataFrame]

#: Rows of a range, on average: what one task orders.
RANGE_ROWS = 200_000
PART = "part"


def in_ranges(
    df: DataFrame, by: Sequence[str], keep: Keep = checkpointed, range_rows: int | None = None
) -> DataFrame:
    """The rows with ``part``, the number of their range: rows equal in ``by`` share one, and a row of a later
    range comes after all of an earlier one.

    ``by`` should nearly identify rows, as equal rows cannot be cut; collapse them first. The
    ranges come from a sample, so they are stored at once (``keep``): both the totals and the
    rows must see the same ones. ``df`` is read three times and should be a stored table.
    """
    parts = max(1, -(-df.count() // (range_rows or RANGE_ROWS)))
    return keep(df.repartitionByRange(parts, *by).withColumn(PART, F.spark_partition_id()))


def before_ranges(placed: DataFrame, keys: Sequence[str], amount: Column, name: str) -> DataFrame:
    """(keys, part, name): the sum of ``amount`` in the earlier ranges of each group."""
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(*keys, PART).agg(F.sum(amount).alias(name))
    return heads.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))


def dense_numbers(
    values: DataFrame, column: str, after: int = 0, keep: Keep = checkpointed, range_rows: int | None = None
) -> DataFrame:
    """(column, number): distinct values numbered from ``after`` + 1 without gaps, in their order.

    ``values`` holds each value once, and none that is missing.
    """
    placed = in_ranges(values.select(column), [column], keep, range_rows)
    heads = before_ranges(placed, [], F.lit(1), "earlier")
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(column))
    numbered = placed.withColumn("inside", inside).join(heads, PART)
    return numbered.select(column, (F.col("earlier") + F.col("inside") + after).cast("long").alias("number"))
