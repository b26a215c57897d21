"""Previous values, ranks, top rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import change, change_rate
from shelfscope.operators.ranges import PART, Keep, in_ranges
from shelfscope.sources.kept import checkpointed


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str]
) -> DataFrame:
    """Add the value of the previous observed row (not the previous calendar step).

    Meant for aggregates by time step, where a key has at most one row per step.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({new: F.lag(old).over(window) for old, new in columns.items()})


def with_change(
    df: DataFrame, now: str, before: str, rate: str | None = None, difference: str | None = None
) -> DataFrame:
    added = {}
    if rate:
        added[rate] = change_rate(now, before)
    if difference:
        added[difference] = change(now, before)
    return df.withColumns(added)


def _value_ranks(df: DataFrame, value: str, names: Mapping[str, Sequence[str]], keep: Keep) -> DataFrame:
    """Ranks of the distinct values of each finest group."""
    finest = list(dict.fromkeys(key for keys in names.values() for key in keys))
    ties = keep(df.groupBy(*finest, value).agg(F.count(F.lit(1)).alias("n")))
    # Every rank orders within groups that these keys tell apart.
    common = [key for key in finest if all(key in keys for keys in names.values())]
    placed = in_ranges(ties, [*common, value], keep)
    heads = placed.groupBy(*finest, PART).agg(F.sum("n").alias("n"))
    for name, keys in names.items():
        later = (
            Window.partitionBy(*keys).orderBy(F.desc(PART)).rangeBetween(Window.unboundedPreceding, -1)
        )
        heads = heads.withColumn(f"{name}_above", F.coalesce(F.sum("n").over(later), F.lit(0)))
    placed = placed.join(heads.drop("n"), [*finest, PART])
    for name, keys in names.items():
        mine = Window.partitionBy(*keys, PART)
        reached = mine.orderBy(F.desc(value)).rangeBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        equal = Window.partitionBy(*keys, PART, value)
        rank = F.col(f"{name}_above") + F.sum("n").over(reached) - F.sum("n").over(equal) + 1
        placed = placed.withColumn(name, rank.cast("int"))
    return placed.select(*finest, value, *names)


def with_min_ranks(
    df: DataFrame, ranks: Mapping[str, Mapping[str, Sequence[str]]], keep: Keep = checkpointed
) -> DataFrame:
    """Add ranks from the highest value down; equal values share the smallest rank.

    ``ranks`` maps a value to the names of its ranks and their groups: groups with any number of
    rows, at least one key that all ranks of a value have, and no missing keys or values. A
    window over a whole group would put it into one task. Here equal values of a group collapse
    to a count, the distinct values are sorted into ranges of about ``ranges.RANGE_ROWS`` rows, and
    every row looks its rank up by value. Only the totals of the ranges, a row for each range and
    group, meet in one task. ``df`` is read once more per value, so it should be a stored table;
    two steps per value are stored at once.
    """
    ranked = df
    for value, names in ranks.items():
        found = _value_ranks(df, value, names, keep)
        keys = [c for c in found.columns if c not in names]
        ranked = ranked.join(found, keys)
    return ranked


def top_per_group(df: DataFrame, k: int, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows among the ``k`` highest values of their group, ties included, with their rank.

    Each partition keeps its own best rows of each group and drops the rest before anything is
    shuffled (the plan has ``WindowGroupLimit``), so no group is ever ranked, or met, as a whole.
    Missing values are not ranked.
    """
    best_first = Window.partitionBy(*keys).orderBy(F.desc(value))
    ranked = df.filter(F.col(value).isNotNull()).withColumn(name, F.rank().over(best_first))
    return ranked.filter(F.col(name) <= k)


def top_rows(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def last_rows(
    df: DataFrame, k: int, order: Sequence[Column], reverse: Sequence[Column]
) -> DataFrame:
    """The last ``k`` rows of an ordering, in that ordering."""
    return df.orderBy(*reverse).limit(k).orderBy(*order)
