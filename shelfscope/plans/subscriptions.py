"""Content types, repeat purchases and their annual estimates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numbers import flag, money_sum, ratio, rows
from shelfscope.operators.estimates import annualise
from shelfscope.operators.grouping import drop_all_zero, group_present, spread_sum
from shelfscope.operators.joins import lookup

# Estimated column of each measure.
ESTIMATES = {
    "sales_amount": "estimated_annual_sales_amount",
    "transaction_ct": "estimated_annual_transaction_ct",
    "avg_revenue_per_app": "estimated_annual_revenue_per_app",
    "avg_txn_per_app": "estimated_annual_txn_per_app",
    "avg_revenue_per_content": "estimated_annual_revenue_per_content",
    "avg_txn_per_content": "estimated_annual_txn_per_content",
}


def subscription_transactions(final: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Purchases outside some categories; those without a category stay."""
    kept = final
    for name in excluded:
        kept = kept.filter(~F.col("category_name").eqNullSafe(name))
    return kept.select(
        "app_name",
        "content_id",
        "category_name",
        "parent_app_content_id",
        "inapp_content_type",
        "acct_id",
        "price",
        "transaction_year_month",
        "transaction_dt",
    )


def period_share(activity: DataFrame) -> Column:
    """Length of the observed period as a share of a year."""
    span = F.datediff(F.max("last_dt"), F.min("first_dt"))
    return activity.agg(span / F.lit(365.0)).scalar()


def _by_type(
    subscription: DataFrame, keys: Sequence[str], share: Column, retention: float
) -> DataFrame:
    # Purchases collapse to contents first: several distinct counts multiply the rows they read.
    contents = (
        subscription.dropna(subset=list(keys))
        .groupBy(*keys, "app_name", "parent_app_content_id", "content_id")
        .agg(F.sum("price").alias("price"), rows().alias("n"))
    )
    counted = contents.groupBy(*keys).agg(
        F.countDistinct("app_name").alias("app_name_ct"),
        F.countDistinct("parent_app_content_id").alias("parent_app_content_ct"),
        F.countDistinct("content_id").alias("content_ct"),
        money_sum().alias("sales_amount"),
        F.sum("n").alias("transaction_ct"),
    )
    averaged = counted.withColumns(
        {
            "avg_paid_content_ct_per_app": ratio("content_ct", "parent_app_content_ct"),
            "avg_revenue_per_app": ratio("sales_amount", "parent_app_content_ct"),
            "avg_price_per_txn": ratio("sales_amount", "transaction_ct"),
            "avg_txn_per_app": ratio("transaction_ct", "parent_app_content_ct"),
            "avg_revenue_per_content": ratio("sales_amount", "content_ct"),
            "avg_txn_per_content": ratio("transaction_ct", "content_ct"),
        }
    )
    return annualise(averaged, ESTIMATES, "inapp_content_type", share, retention)


def subscription_summary(
    subscription: DataFrame, share: Column, retention: float = 0.6
) -> DataFrame:
    return _by_type(subscription, ["inapp_content_type"], share, retention)


def subscription_category(
    subscription: DataFrame, share: Column, retention: float = 0.6
) -> DataFrame:
    return _by_type(subscription, ["category_name", "inapp_content_type"], share, retention)


def subscription_content(subscription: DataFrame) -> DataFrame:
    return group_present(subscription, "content_id", "inapp_content_type").agg(
        money_sum().alias("total_revenue"), rows().alias("transaction_ct")
    )


def _suffix(month: str) -> str:
    return month.replace("-", "_")


def purchase_months(
    purchases: DataFrame, keys: Sequence[str], months: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Revenue and purchase flag per month, months bought in, and whether that is several.

    Groups without revenue in any month are left out.
    """
    revenue = {month: f"revenue_{_suffix(month)}" for month in months}
    spread = spread_sum(purchases, keys, "transaction_year_month", revenue, "price", extra=extra)
    spread = drop_all_zero(spread, list(revenue.values()))
    flags = {f"purchase_{_suffix(m)}": flag(F.col(revenue[m]) > 0) for m in months}
    flagged = spread.withColumns(
        {c: F.col(c).cast("double") for c in revenue.values()}
    ).withColumns(flags)
    counted = flagged.withColumn(
        "purchase_month_ct", reduce(lambda a, b: a + b, [F.col(f) for f in flags], F.lit(0))
    )
    return counted.withColumn("repeat_purchase", flag(F.col("purchase_month_ct") > 1))


def monthly_purchase_matrix(
    subscription: DataFrame, app_dim: DataFrame, months: Sequence[str]
) -> DataFrame:
    """Account by content, with the first purchase day and the content's app.

    A content belongs to one category, so the first day in ``subscription`` is the first of all.
    """
    first = F.min("transaction_dt").alias("first_txn_dt")
    matrix = purchase_months(subscription, ["acct_id", "content_id"], months, [first])
    contents = app_dim.dropna(subset=["content_id"]).drop("content_id_modified")
    return lookup(matrix, contents, "content_id")


def content_repeats(pairs: DataFrame) -> DataFrame:
    """Account-content pairs and repeats by content, before any attribute is joined.

    Pairs of a bestseller are added up before the shuffle, so none of its rows meet in a join.
    """
    return pairs.groupBy("content_id").agg(
        rows().alias("acct_content_ct"), F.sum("repeat_purchase").alias("repeat_purchase_acct_ct")
    )


def _with_attributes(repeats: DataFrame, app_dim: DataFrame) -> DataFrame:
    contents = app_dim.dropna(subset=["content_id"]).drop("content_id_modified")
    return lookup(repeats, contents, "content_id")


def repeat_purchase_by_type(repeats: DataFrame, app_dim: DataFrame) -> DataFrame:
    return (
        group_present(_with_attributes(repeats, app_dim), "category_name", "inapp_content_type")
        .agg(
            F.sum("acct_content_ct").alias("acct_content_ct"),
            F.countDistinct("content_id").alias("content_ct"),
            F.sum("repeat_purchase_acct_ct").alias("repeat_purchase_acct_ct"),
        )
        .withColumn("avg_purchase_acct_per_content", ratio("acct_content_ct", "content_ct"))
        .withColumn(
            "avg_repeat_purchase_acct_per_content", ratio("repeat_purchase_acct_ct", "content_ct")
        )
    )


def repeat_by_content(repeats: DataFrame, app_dim: DataFrame, category: str) -> DataFrame:
    """Accounts that came back per content of one category."""
    of_category = _with_attributes(repeats, app_dim).filter(F.col("category_name") == category)
    return group_present(of_category, "content_id", "inapp_content_type").agg(
        F.sum("repeat_purchase_acct_ct").alias("repeat_purchase_acct_ct")
    )


def repeat_purchase_summary(final: DataFrame, months: Sequence[str]) -> DataFrame:
    """Account-content pairs per category and per content; the sum counts repeats only."""
    pairs = purchase_months(final, ["acct_id", "content_id", "category_name"], months)
    return (
        pairs.groupBy("category_name")
        .agg(
            F.count("repeat_purchase").alias("repeat_purchase_ct"),
            F.sum("repeat_purchase").alias("repeat_purchase_sum"),
            F.countDistinct("content_id").alias("content_ct"),
        )
        .withColumn("avg_repeat_purchase_ct", ratio("repeat_purchase_ct", "content_ct"))
    )
