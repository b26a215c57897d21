"""Dimension of apps and contents, and the transaction facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import dates
from shelfscope.functions.bands import price_band, tenure_band
from shelfscope.functions.numbers import flag
from shelfscope.functions.text import clean_app_name
from shelfscope.operators.joins import (
    keep_both,
    lookup,
    lookup_where,
    with_fallback,
)

APP_COLUMNS = [
    "app_name",
    "parent_app_content_id",
    "category_id",
    "category_name",
    "app_device_id",
    "app_device_name",
]


def named_transactions(transaction: DataFrame) -> DataFrame:
    return transaction.withColumnsRenamed(
        {
            "create_dt": "transaction_dt",
            "content_id": "transaction_content_id",
            "device_id": "transaction_device_id",
        }
    )


def distinct_transactions(transaction: DataFrame) -> DataFrame:
    """Purchases without exact copies."""
    return named_transactions(transaction).dropDuplicates()


def account_dimension(account: DataFrame) -> DataFrame:
    return account.withColumnsRenamed({"create_dt": "account_create_dt"})


def app_dimension(
    app: DataFrame, inapp: DataFrame, category: DataFrame, device: DataFrame
) -> DataFrame:
    """One row per in-app content, and one per app without any; contents without app stay."""
    apps = app.withColumnsRenamed({"content_id": "parent_app_content_id"})
    contents = inapp.withColumnsRenamed({"type": "inapp_content_type"})
    joined = keep_both(apps, contents, "parent_app_content_id")
    described = lookup(lookup(joined, category, "category_id"), device, "device_id")
    return described.withColumnsRenamed(
        {"device_id": "app_device_id", "device_name": "app_device_name"}
    ).select(
        "parent_app_content_id",
        clean_app_name(F.col("app_name")).alias("app_name"),
        "category_id",
        "category_name",
        "app_device_id",
        "app_device_name",
        "content_id",
        "inapp_content_type",
        F.coalesce("content_id", "parent_app_content_id").alias("content_id_modified"),
    )


def content_lookup(app_dim: DataFrame) -> DataFrame:
    """What a purchased id resolves to: a content first, else the app it names.

    Purchases of an app that has contents carry no content id and no content type.
    """
    key = "transaction_content_id"
    contents = app_dim.filter(F.col("parent_app_content_id").isNotNull()).select(
        F.col("content_id_modified").alias(key), *APP_COLUMNS, "content_id", "inapp_content_type"
    )
    whole_apps = (
        app_dim.filter(F.col("content_id").isNotNull())
        .select(F.col("parent_app_content_id").alias(key), *APP_COLUMNS)
        .dropna(subset=[key])
        .distinct()
        .withColumns(
            {
                "content_id": F.lit(None).cast("string"),
                "inapp_content_type": F.lit(None).cast("string"),
            }
        )
    )
    return with_fallback(contents, whole_apps, key)


def resolved_transactions(
    transactions: DataFrame, app_dim: DataFrame, device: DataFrame
) -> DataFrame:
    """Distinct purchases with the app, content and device behind them."""
    named = device.select(
        F.col("device_id").alias("known_device_id"),
        F.col("device_name").alias("transaction_device_name"),
    )
    resolved = lookup(transactions, content_lookup(app_dim), "transaction_content_id")
    return lookup_where(
        resolved, named, F.col("transaction_device_id") == F.col("known_device_id")
    ).select(
        "transaction_dt",
        "transaction_content_id",
        "acct_id",
        "price",
        "transaction_device_id",
        *APP_COLUMNS,
        "content_id",
        "inapp_content_type",
        "transaction_device_name",
    )


def transaction_fact(resolved: DataFrame, account: DataFrame) -> DataFrame:
    """Resolved purchases with the account's opening day and payment type."""
    return lookup(resolved, account_dimension(account), "acct_id").select(
        *resolved.columns, "account_create_dt", "payment_type"
    )


def ordinary_purchases(resolved: DataFrame, traits: DataFrame) -> DataFrame:
    """Purchases of accounts that are no outliers, with what is known of the account.

    ``traits`` holds one row per buying account, so account attributes, account group, paid
    flag and outlier mark arrive in a single join of the purchases, and none needs a window
    over an account's purchases. One join also leaves Spark free to split the partition of an
    account with very many purchases.
    """
    known = lookup(resolved, traits.drop("first_dt", "last_dt"), "acct_id")
    return (
        known.filter(~F.coalesce("is_outlier", F.lit(False)))
        .drop("is_outlier")
        .select(
            *resolved.columns,
            "account_create_dt",
            "payment_type",
            "acct_txn_group",
            F.coalesce("paid_acct_flag", F.lit(0)).alias("paid_acct_flag"),
            dates.year_month(F.col("transaction_dt")).alias("transaction_year_month"),
        )
    )


def final_fact(purchases: DataFrame, traits: DataFrame) -> DataFrame:
    """Ordinary purchases with calendar, tenure, band and price attributes.

    The edges of the tenure bands are those of the purchases, but follow from ``traits``.
    """
    edges = (
        traits.filter(~F.col("is_outlier"))
        .agg(
            F.struct(
                F.min(F.datediff("first_dt", "account_create_dt")).alias("lowest"),
                F.max(F.datediff("last_dt", "account_create_dt")).alias("highest"),
            )
        )
        .scalar()
    )
    day = F.col("transaction_dt")
    days = F.datediff(day, "account_create_dt")
    months = dates.months_in(days)
    lowest, highest = dates.months_in(edges["lowest"]), dates.months_in(edges["highest"])
    return purchases.withColumns(
        {
            "transaction_year": F.year(day),
            "transaction_month": F.month(day),
            "transaction_weekday": dates.weekday_number(day),
            "transaction_weekday_nm": dates.weekday_name(day),
            "transaction_week": dates.iso_week(day),
            "first_day_of_the_week": dates.week_start(day),
            "acct_tenure_days": days,
            "acct_tenure_months": months,
            "acct_tenure_years": dates.years_in(days),
            "tenure_band": tenure_band(months, lowest, highest),
            "transaction_without_acct": flag(day < F.col("account_create_dt")),
            "free_transaction_flag": flag(F.col("price") == 0),
            "price_band": price_band(F.col("price")),
        }
    )
