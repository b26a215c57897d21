"""Two-sample comparisons of the market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfscope.operators.estimates import two_sample_interval
from shelfscope.plans.subscriptions import repeat_by_content
from shelfscope.schemas import CONSUMABLE, PAY_FREE, PAY_ON_FILE, SUBSCRIPTION


def payment_test(summary: DataFrame, z: float = 1.96) -> DataFrame:
    """Purchases per account, free-only accounts against those with a payment method."""
    return two_sample_interval(summary, "payment_type", PAY_FREE, PAY_ON_FILE, "total_txn", z)


def content_test(contents: DataFrame, measure: str, z: float = 1.96) -> DataFrame:
    """Purchases or revenue per content, consumables against subscriptions."""
    return two_sample_interval(
        contents, "inapp_content_type", CONSUMABLE, SUBSCRIPTION, measure, z
    )


def repeat_test(
    repeats: DataFrame, app_dim: DataFrame, category: str, z: float = 1.96
) -> DataFrame:
    """Returning accounts per content of one category, consumables against subscriptions."""
    return content_test(
        repeat_by_content(repeats, app_dim, category), "repeat_purchase_acct_ct", z
    )
