"""Summary statistics, quantiles and histograms without collecting values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.numbers import ratio, rows
from shelfscope.operators.grouping import fill_bands
from shelfscope.operators.ranges import Keep, in_ranges
from shelfscope.sources.kept import checkpointed

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, ct): all columns below each other, equal values collapsed."""
    return (
        df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
        .unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count("value").alias("ct"))
    )


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, keep: Keep = checkpointed
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per numeric column.

    Quartiles interpolate linearly; NaN counts as missing. ``df`` is read once: equal values
    collapse to a count, and the distinct values are sorted into ranges, so no task holds all of
    them; missing ones lie below all others. The ranges' totals, a row for each range of a column,
    tell how many values lie below. Two steps are stored when this is called.
    """
    counted = keep(_counted(df, columns or numeric_columns(df)))
    counted = in_ranges(counted, ["column_name", "value"], keep).withColumnRenamed("part", "slice")
    whole = Window.partitionBy("column_name")
    below = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        counted.groupBy("column_name", "slice")
        .agg(
            F.sum("ct").alias("slice_ct"),
            F.sum(F.col("value") * F.col("ct")).alias("slice_sum"),
            F.min("value").alias("slice_min"),
            F.max("value").alias("slice_max"),
        )
        .select(
            "column_name",
            "slice",
            F.coalesce(F.sum("slice_ct").over(below), F.lit(0)).alias("below"),
            F.sum("slice_ct").over(whole).alias("n"),
            ratio(F.sum("slice_sum").over(whole), F.sum("slice_ct").over(whole)).alias("mean"),
            F.min("slice_min").over(whole).alias("lowest"),
            F.max("slice_max").over(whole).alias("highest"),
        )
    )
    upto = (
        Window.partitionBy("column_name", "slice")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = counted.join(slices, ["column_name", "slice"]).withColumn(
        "reached", F.col("below") + F.sum("ct").over(upto)
    )

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("reached") >= position + 1, F.col("value")))

    def place(q: float) -> Column:
        return (F.col("n") - 1) * F.lit(q)

    ends = [
        c
        for q in QUARTILES
        for c in (
            at(F.floor(place(q))).alias(f"low_{q}"),
            at(F.ceil(place(q))).alias(f"high_{q}"),
        )
    ]
    off = F.col("value") - F.col("mean")
    found = placed.groupBy("column_name", "n", "mean", "lowest", "highest").agg(
        F.sum(off * off * F.col("ct")).alias("squares"), *ends
    )

    def quartile(q: float) -> Column:
        low, high = F.col(f"`low_{q}`"), F.col(f"`high_{q}`")
        step = place(q) - F.floor(place(q))
        return F.round(low + (high - low) * step, 6).alias(f"q{int(q * 100)}")

    return found.select(
        "column_name",
        F.col("n").alias("value_ct"),
        F.round("mean", 6).alias("mean"),
        F.round(F.sqrt(ratio("squares", F.col("n") - 1)), 6).alias("std"),
        F.col("lowest").alias("min"),
        *[quartile(q) for q in QUARTILES],
        F.col("highest").alias("max"),
    )


def histogram(
    df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Row counts of equal-width bins over ``[low, high]``; empty bins show 0.

    A limit that is not given is the observed extreme. Bin 0 counts what lies below the lowest
    limit and the one after the last what lies above the highest, so the counts add up to all
    rows with a value.
    """
    value = F.nanvl(F.col(column).cast("double"), F.lit(None))
    seen = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    start = seen["low"] if low is None else F.lit(float(low))
    end = seen["high"] if high is None else F.lit(float(high))
    place = F.least(F.coalesce(F.width_bucket(value, start, end, F.lit(bins)), F.lit(1)), F.lit(bins))
    number = F.when(value < start, 0).when(value > end, bins + 1).otherwise(place).cast("int")
    counted = df.filter(value.isNotNull()).groupBy(number.alias("bin")).agg(rows().alias("row_ct"))
    width, inside = (end - start) / bins, F.col("bin").between(1, bins)
    return fill_bands(counted, {"bin": list(range(bins + 2))}).select(
        "bin",
        F.when(inside, start + (F.col("bin") - 1) * width)
        .when(F.col("bin") > bins, end)
        .alias("bin_start"),
        F.when(inside, start + F.col("bin") * width)
        .when(F.col("bin") < 1, start)
        .alias("bin_end"),
        "row_ct",
    )
