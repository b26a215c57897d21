"""Regular prices and promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numbers import flag, ratio, rows
from shelfscope.operators.grouping import group_present
from shelfscope.operators.joins import lookup


def price_days(final: DataFrame) -> DataFrame:
    """Days and purchases per content and price."""
    return group_present(final, "content_id", "price").agg(
        F.countDistinct("transaction_dt").alias("price_occur_days"),
        rows().alias("transaction_ct"),
    )


def regular_price(final: DataFrame) -> DataFrame:
    """Per content the most frequent price and the price held on most days.

    Ties go to the lower price. Purchases are collapsed to one row per price before the
    contents are compared, so a bestseller weighs no more than any other content.
    """
    most_bought = F.struct((-F.col("transaction_ct")).alias("n"), F.col("price"))
    longest = F.struct((-F.col("price_occur_days")).alias("n"), F.col("price"))
    return (
        price_days(final)
        .groupBy("content_id")
        .agg(
            F.min_by("price", most_bought).alias("modal_price"),
            F.min_by("price", longest).alias("regular_price"),
        )
    )


def priced_transactions(final: DataFrame, prices: DataFrame) -> DataFrame:
    """Purchases with the regular price, a promotion flag and the rate below it."""
    regular = prices.select("content_id", "regular_price")
    return lookup(final, regular, "content_id").withColumns(
        {
            "promotion_flag": flag(F.col("price") < F.col("regular_price")),
            "promotion_rate": F.lit(1.0) - ratio("price", "regular_price"),
        }
    )


def promotions(final: DataFrame, prices: DataFrame) -> DataFrame:
    """Purchases below the regular price."""
    return priced_transactions(final, prices).filter(F.col("promotion_flag") == 1)
