"""Equi-joins of a large table with lookups.

No join here carries a broadcast hint. Spark broadcasts a side when its known size is under
``spark.sql.autoBroadcastJoinThreshold`` and sorts or hashes both sides otherwise, and its
adaptive skew handling splits a hot key of the large (left) side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join: every row stays, attributes of unmatched rows are missing."""
    return df.join(other, on, "left")


def lookup_where(df: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """Left join on differently named keys."""
    return df.join(other, condition, "left")


def keep_both(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "full_outer")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the id set; rows without a key stay."""
    return df.join(ids.select(key), key, "left_anti")


def with_fallback(content: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """One lookup of two levels: a fallback row counts only where its key has no content row.

    Joining the large table once with this union gives the rows that two joins and a coalesce
    would, with one shuffle less.
    """
    return content.unionByName(without_ids(fallback, content, key))


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row that tells whether a step kept the number of rows."""
    return before.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before",
        after.agg(F.count(F.lit(1))).scalar().alias("rows_after"),
    ).withColumn("same_count", F.col("rows_before") == F.col("rows_after"))
