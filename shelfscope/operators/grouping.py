"""Grouping, spreading, filling and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import ratio


def group_present(df: DataFrame, *keys: str) -> GroupedData:
    """Group by keys, leaving out rows where a key is missing."""
    return df.dropna(subset=list(keys)).groupBy(*keys)


def spread_sum(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    columns: Mapping[str, str],
    value: str,
    fill: float | None = 0,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key, one total per listed value of ``column``.

    Conditional sums need a single shuffle by the keys; ``groupBy().pivot()`` needs one by
    keys and column and a second by keys. ``fill`` goes to combinations without rows; None
    keeps them missing. ``extra`` aggregates ride along.
    """
    totals = []
    for wanted, name in columns.items():
        total = F.sum(F.when(F.col(column) == F.lit(wanted), F.col(value)))
        if fill is not None:
            total = F.coalesce(total, F.lit(fill))
        totals.append(total.alias(name))
    return group_present(df.dropna(subset=[column]), *keys).agg(*totals, *extra)


def drop_all_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where at least one of the columns is not zero."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns], F.lit(False)))


def frequencies(df: DataFrame, *keys: str, name: str = "row_ct") -> DataFrame:
    return group_present(df, *keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "row_ct") -> DataFrame:
    """Frequencies of one column, most frequent first."""
    return frequencies(df, column, name=name).orderBy(F.desc(name), F.asc(column))


def fill_bands(
    grouped: DataFrame, bands: Mapping[str, Sequence], keys: Sequence[str] = ()
) -> DataFrame:
    """Every band combination for every observed key; absent ones get zero measures.

    ``grouped`` holds one row per (keys, bands), so each key has at most as many rows as there
    are band combinations. They are folded into a map and laid out again along the label
    lists: no join, and ``grouped`` is computed once.
    """
    measures = [c for c in grouped.columns if c not in bands and c not in keys]
    cell = F.struct(*[F.col(b) for b in bands])
    present = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    entry = F.when(present, F.struct(cell.alias("key"), F.struct(*measures).alias("value")))
    kept = grouped.dropna(subset=list(keys)) if keys else grouped
    folded = kept.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    for name, labels in bands.items():
        folded = folded.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    found = F.try_element_at(F.col("cells"), cell)
    return folded.withColumn("found", found).select(
        *keys,
        *bands,
        *[
            F.coalesce(F.col("found")[m], F.lit(0).cast(grouped.schema[m].dataType)).alias(m)
            for m in measures
        ],
    )


def share_of_total(part: str) -> Column:
    """Share in the total of the column. For aggregates with few rows: one window over all."""
    return ratio(F.col(part), F.sum(part).over(Window.partitionBy()))


def money_share(part: str) -> Column:
    """Share in a total of money, added exactly. For aggregates with few rows."""
    exact = F.col(part).cast("decimal(18,2)")
    return ratio(F.col(part), F.sum(exact).over(Window.partitionBy()))


def share_of_group(part: str, *keys: str) -> Column:
    return ratio(F.col(part), F.sum(part).over(Window.partitionBy(*keys)))


def index_to_lowest(value: str) -> Column:
    """Value relative to the smallest one. For aggregates with few rows."""
    return ratio(F.col(value), F.min(value).over(Window.partitionBy()))
