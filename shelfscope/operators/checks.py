"""Data-quality checks. Every check is a DataFrame; nothing is printed or collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.numbers import ratio, rows
from shelfscope.operators.joins import without_ids
from shelfscope.sources.kept import Profile


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_ct")


def column_profile(df: DataFrame) -> DataFrame:
    """Type and present values per column."""
    kinds = F.create_map(
        *[F.lit(x) for field in df.schema for x in (field.name, field.dataType.simpleString())]
    )
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "value_ct").select(
        "column_name", F.try_element_at(kinds, F.col("column_name")).alias("data_type"), "value_ct"
    )


def profile_rows(spark: SparkSession, profiles: Mapping[str, Profile]) -> DataFrame:
    """(table_name, column_name, data_type, value_ct, null_ct) of what was counted: a row for each column."""
    found = [
        (name, field.name, field.dataType.simpleString(), p.value_ct[field.name], p.row_ct - p.value_ct[field.name])
        for name, p in profiles.items()
        for field in p.schema
    ]
    kinds = "table_name string, column_name string, data_type string, value_ct long, null_ct long"
    return spark.createDataFrame(found, kinds)


def duplicate_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows, surplus copies, their rate in percent, and uniqueness.

    Equal rows collapse before the shuffle, so a row copied very often is no hot spot.
    """
    total, surplus = F.col("total_rows"), F.col("duplicate_ct")
    return (
        df.groupBy(*(columns or df.columns))
        .agg(rows().alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
            rows().alias("distinct_rows"),
        )
        .withColumn("duplicate_ct", total - F.col("distinct_rows"))
        .withColumn("duplicate_rate", F.round(ratio(surplus, total) * 100, 2))
        .withColumn("is_unique", surplus == 0)
    )


def ambiguous_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names borne by several keys."""
    return (
        df.dropna(subset=[name])
        .groupBy(name)
        .agg(F.countDistinct(key).alias("app_ct"))
        .filter(F.col("app_ct") > 1)
    )


def period(df: DataFrame, day: str) -> DataFrame:
    """First and last day, days spanned, days without rows, and the share of a year.

    The days are collapsed first, so the rest works on one row per day.
    """
    span = F.datediff(F.col("period_end"), F.col("period_start"))
    return (
        df.groupBy(day)
        .agg(F.lit(1))
        .agg(
            F.min(day).alias("period_start"),
            F.max(day).alias("period_end"),
            F.count(day).alias("days_seen"),
        )
        .withColumn("period_days", span)
        .withColumn("missing_days", span + 1 - F.col("days_seen"))
        .withColumn("period_ratio", span / F.lit(365.0))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "distinct_ct")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def orphan_keys(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys of the fact that the dimension lacks, with the rows they stand on."""
    return without_ids(fact.groupBy(key).agg(rows().alias("row_ct")), dimension, key)


def labelled(parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Reports of several tables below each other."""
    return reduce(
        lambda a, b: a.unionByName(b),
        [df.select(F.lit(name).alias(label), "*") for name, df in parts.items()],
    )
