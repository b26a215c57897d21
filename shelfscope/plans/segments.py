"""Categories, devices, contents and first appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import money_sum, ratio, rows
from shelfscope.operators.grouping import (
    fill_bands,
    frequencies,
    group_present,
    index_to_lowest,
    money_share,
    share_of_group,
    share_of_total,
)
from shelfscope.schemas import BOTH_DEVICES, PRICE_LABELS, TENURE_LABELS


def _amounts(df: DataFrame, key: str) -> DataFrame:
    return (
        group_present(df, key)
        .agg(money_sum().alias("total_revenue"), rows().alias("total_transaction_ct"))
        .withColumn("avg_transaction_amt", ratio("total_revenue", "total_transaction_ct"))
    )


def _with_shares(amounts: DataFrame) -> DataFrame:
    return amounts.withColumns(
        {
            "transaction_share": share_of_total("total_transaction_ct"),
            "revenue_share": money_share("total_revenue"),
            "avg_transaction_amt_index": index_to_lowest("avg_transaction_amt"),
        }
    ).withColumn("total_transaction_ct", F.col("total_transaction_ct").cast("double"))


def category_summary(final: DataFrame) -> DataFrame:
    return _with_shares(_amounts(final, "category_name"))


def device_summary(final: DataFrame) -> DataFrame:
    return _with_shares(_amounts(final, "transaction_device_name"))


def device_summary_both(final: DataFrame, both: str = BOTH_DEVICES) -> DataFrame:
    """Devices by the revenue of apps made for both, against the purchases of all apps.

    ``both_*`` columns count only the purchases of those apps. One pass gives both sides.
    """
    mine = F.col("app_device_name") == F.lit(both)
    return _with_shares(
        group_present(final, "transaction_device_name")
        .agg(
            money_sum(F.when(mine, F.col("price"))).alias("total_revenue"),
            rows().alias("total_transaction_ct"),
            F.count_if(mine).alias("both_transaction_ct"),
        )
        .filter(F.col("both_transaction_ct") > 0)
        .withColumn("avg_transaction_amt", ratio("total_revenue", "total_transaction_ct"))
        .withColumn("both_avg_transaction_amt", ratio("total_revenue", "both_transaction_ct"))
    )


def apps_by_device(app_dim: DataFrame) -> DataFrame:
    counted = group_present(app_dim, "app_device_name").agg(
        F.countDistinct("parent_app_content_id").alias("app_ct"), rows().alias("row_ct")
    )
    return counted.withColumn("app_share", share_of_total("app_ct"))


def txn_by_payment(final: DataFrame) -> DataFrame:
    return frequencies(final, "payment_type", name="transaction_ct")


def txn_by_content_type(final: DataFrame) -> DataFrame:
    return frequencies(final, "inapp_content_type", name="transaction_ct")


def app_content_summary(app_dim: DataFrame) -> DataFrame:
    """Apps and contents per category and type, with shares in the category and overall."""
    counted = group_present(app_dim, "category_name", "inapp_content_type").agg(
        F.countDistinct("parent_app_content_id").alias("app_ct"),
        F.countDistinct("content_id").alias("content_ct"),
    )
    return counted.withColumns(
        {
            "category_app_ct": F.sum("app_ct").over(Window.partitionBy("category_name")),
            "total_app_ct": F.sum("app_ct").over(Window.partitionBy()),
            "category_app_share": share_of_group("app_ct", "category_name"),
            "total_app_share": share_of_total("app_ct"),
        }
    )


def tenure_performance(final: DataFrame) -> DataFrame:
    """Tenure bands, empty ones included, with averages per account and shares."""
    counted = final.groupBy("tenure_band").agg(
        F.countDistinct("acct_id").alias("acct_ct"),
        money_sum().alias("revenue"),
        F.sum("free_transaction_flag").alias("free_transaction_ct"),
        rows().alias("transaction_ct"),
    )
    return (
        fill_bands(counted, {"tenure_band": TENURE_LABELS})
        .withColumn("avg_free_transaction_ct", ratio("free_transaction_ct", "acct_ct"))
        .withColumn("avg_transaction_ct", ratio("transaction_ct", "acct_ct"))
        .withColumn("avg_revenue_amount", ratio("revenue", "acct_ct"))
        .withColumn("avg_transaction_amount", ratio("avg_revenue_amount", "avg_transaction_ct"))
        .withColumn(
            "paid_transaction_rate",
            F.lit(1.0) - ratio("avg_free_transaction_ct", "avg_transaction_ct"),
        )
        .withColumns(
            {
                "transaction_share": share_of_total("transaction_ct"),
                "free_transaction_share": share_of_total("free_transaction_ct"),
                "revenue_share": money_share("revenue"),
            }
        )
    )


def tenure_price_performance(final: DataFrame) -> DataFrame:
    counted = final.groupBy("tenure_band", "price_band").agg(
        F.countDistinct("acct_id").alias("acct_ct"),
        money_sum().alias("revenue"),
        rows().alias("transaction_ct"),
    )
    filled = fill_bands(counted, {"tenure_band": TENURE_LABELS, "price_band": PRICE_LABELS})
    return filled.withColumn("avg_transaction_amount", ratio("revenue", "transaction_ct"))


def devices_per_account(final: DataFrame) -> DataFrame:
    return group_present(final, "acct_id").agg(
        F.countDistinct("transaction_device_id").alias("device_ct")
    )


def content_first_seen(final: DataFrame) -> DataFrame:
    return group_present(final, "parent_app_content_id", "app_name", "content_id").agg(
        F.min("transaction_dt").alias("first_txn_dt")
    )
