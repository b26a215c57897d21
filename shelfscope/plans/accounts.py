"""Account tables: activity, summary, outliers and their breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import dates
from shelfscope.functions.bands import tenure_band
from shelfscope.functions.numbers import flag, money_sum, ratio, rows
from shelfscope.operators.grouping import (
    fill_bands,
    frequencies,
    group_present,
    share_of_group,
    share_of_total,
    spread_sum,
)
from shelfscope.operators.joins import lookup, without_ids
from shelfscope.operators.profile import describe, histogram
from shelfscope.plans.facts import account_dimension
from shelfscope.plans.trends import in_week
from shelfscope.schemas import (
    ACTIVE,
    CATEGORY_COLUMNS,
    DORMANT,
    FREE_ONLY,
    PURCHASED,
    TENURE_LABELS,
    TENURE_LABELS_RECUT,
)

def _revenue_columns(categories: Mapping[str, str]) -> dict[str, str]:
    return {name: f"{column}_revenue" for name, column in categories.items()}


def account_activity(
    resolved: DataFrame, categories: Mapping[str, str] = CATEGORY_COLUMNS
) -> DataFrame:
    """Per buying account: revenue by category, totals, first and last day. One pass.

    Rows without an account form one row of their own here, so that the overall period can be
    read from this table.
    """
    by_category = [
        F.coalesce(
            F.sum(F.when(F.col("category_name") == F.lit(name), F.col("price"))), F.lit(0)
        ).alias(column)
        for name, column in _revenue_columns(categories).items()
    ]
    return resolved.groupBy("acct_id").agg(
        *by_category,
        F.coalesce(F.sum("price"), F.lit(0)).alias("total_revenue"),
        rows().alias("total_txn"),
        F.min("transaction_dt").alias("first_dt"),
        F.max("transaction_dt").alias("last_dt"),
    )


def revenue_by_account_category(
    resolved: DataFrame, categories: Mapping[str, str] = CATEGORY_COLUMNS
) -> DataFrame:
    """One revenue column per category, for accounts that bought in any category."""
    columns = _revenue_columns(categories)
    spread = spread_sum(resolved, ["acct_id"], "category_name", columns, "price")
    return spread.select("acct_id", *[F.col(c).cast("double").alias(c) for c in columns.values()])


def _tenure(
    df: DataFrame, until: Column, lowest: Column, highest: Column, labels: Sequence[str]
) -> DataFrame:
    days = F.datediff(until, "account_create_dt")
    months = dates.months_in(F.col("acct_tenure_days"))
    return df.withColumn("acct_tenure_days", days).withColumns(
        {
            "acct_tenure_months": months,
            "acct_tenure_years": dates.years_in(F.col("acct_tenure_days")),
            "tenure_band": tenure_band(months, lowest, highest, labels),
        }
    )


def account_summary(
    account: DataFrame,
    activity: DataFrame,
    low_limit: int = 101,
    categories: Mapping[str, str] = CATEGORY_COLUMNS,
) -> DataFrame:
    """Every account with its totals, flags, tenure and activity group.

    Accounts without purchases get zero totals and the dormant flag.
    """
    revenue = list(_revenue_columns(categories).values())
    accounts = account_dimension(account)
    until = activity.agg(F.max("last_dt")).scalar()
    opened = accounts.agg(
        F.struct(
            F.min("account_create_dt").alias("first"), F.max("account_create_dt").alias("last")
        )
    ).scalar()
    joined = lookup(accounts, activity.drop("first_dt", "last_dt"), "acct_id")
    bought = F.col("total_txn").isNotNull()
    paid = (
        F.when(F.col("total_revenue") > 0, PURCHASED).when(bought, FREE_ONLY).otherwise(DORMANT)
    )
    group = (
        F.when(~bought, DORMANT).when(F.col("total_txn") <= low_limit, "Low").otherwise("High")
    )
    flagged = joined.select(
        "acct_id",
        "account_create_dt",
        "payment_type",
        *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in revenue],
        F.coalesce("total_revenue", F.lit(0)).cast("double").alias("total_revenue"),
        F.coalesce("total_txn", F.lit(0)).alias("total_txn"),
        paid.alias("paid_acct_flag"),
        F.when(bought, ACTIVE).otherwise(DORMANT).alias("no_txn_flag"),
        group.alias("acct_txn_group"),
        ratio("total_revenue", "total_txn").alias("avg_spend_amount"),
    )
    return _tenure(
        flagged,
        until,
        dates.months_in(F.datediff(until, opened["last"])),
        dates.months_in(F.datediff(until, opened["first"])),
        TENURE_LABELS,
    )


def recut_account_tenure(
    summary: DataFrame, final: DataFrame, labels: Sequence[str] = TENURE_LABELS_RECUT
) -> DataFrame:
    """Account tenure up to the last ordinary purchase, banded by the purchases' edges."""
    seen = final.agg(
        F.struct(
            F.max("transaction_dt").alias("until"),
            F.min("acct_tenure_days").alias("lowest"),
            F.max("acct_tenure_days").alias("highest"),
        )
    ).scalar()
    kept = summary.drop(
        "acct_tenure_days", "acct_tenure_months", "acct_tenure_years", "tenure_band"
    )
    return _tenure(
        kept,
        seen["until"],
        dates.months_in(seen["lowest"]),
        dates.months_in(seen["highest"]),
        labels,
    )


def outlier_accounts(
    summary: DataFrame, max_revenue: float = 10000, max_transactions: int = 1000
) -> DataFrame:
    """Ids of accounts above a threshold, with the threshold they break."""
    spends = F.col("total_revenue") > max_revenue
    buys = F.col("total_txn") > max_transactions
    return summary.filter(spends | buys).select(
        "acct_id",
        spends.alias("above_revenue"),
        buys.alias("above_transactions"),
    )


def account_traits(activity: DataFrame, summary: DataFrame, outliers: DataFrame) -> DataFrame:
    """What the final fact needs of every buying account, known to the account table or not."""
    bought = activity.dropna(subset=["acct_id"]).select(
        "acct_id",
        "first_dt",
        "last_dt",
        flag(F.col("total_revenue") > 0).alias("paid_acct_flag"),
    )
    known = summary.select("acct_id", "account_create_dt", "payment_type", "acct_txn_group")
    marks = outliers.select("acct_id", F.lit(True).alias("is_outlier"))
    return lookup(lookup(bought, known, "acct_id"), marks, "acct_id").withColumn(
        "is_outlier", F.coalesce("is_outlier", F.lit(False))
    )


def extreme_accounts(summary: DataFrame) -> DataFrame:
    """Accounts with the highest revenue or the most purchases."""
    top = summary.agg(
        F.struct(F.max("total_revenue").alias("revenue"), F.max("total_txn").alias("txn"))
    ).scalar()
    return summary.filter(
        (F.col("total_revenue") == top["revenue"]) | (F.col("total_txn") == top["txn"])
    )


def account_share(summary: DataFrame, by: str, name: str) -> DataFrame:
    """Accounts per flag value and their share."""
    counted = group_present(summary, by).agg(F.countDistinct("acct_id").alias(name))
    return counted.withColumn("acct_share", share_of_total(name))


def active_share(summary: DataFrame) -> DataFrame:
    return account_share(summary, "no_txn_flag", "no_txn_acct_ct")


def paid_share(summary: DataFrame) -> DataFrame:
    return account_share(summary, "paid_acct_flag", "paid_acct_ct")


def measure_histogram(
    summary: DataFrame,
    measure: str,
    bins: int,
    with_zero: bool = True,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Accounts by revenue or purchases, with or without those that have none."""
    kept = summary if with_zero else summary.filter(F.col(measure) != 0)
    return histogram(kept, measure, bins, low, high)


def trimmed_summary(
    summary: DataFrame,
    max_revenue: float = 10000,
    max_transactions: int = 1000,
    active_only: bool = False,
) -> DataFrame:
    """Summary statistics of the accounts within both thresholds."""
    kept = summary.filter(
        (F.col("total_txn") <= max_transactions) & (F.col("total_revenue") <= max_revenue)
    )
    if active_only:
        kept = kept.filter(F.col("total_txn") != 0)
    return describe(kept)


def tenure_counts(summary: DataFrame, by: str) -> DataFrame:
    """Accounts per tenure band and another key, with empty bands."""
    counted = summary.groupBy("tenure_band", by).agg(rows().alias("acct_ct"))
    return fill_bands(counted, {"tenure_band": TENURE_LABELS}, [by])


def account_counts(summary: DataFrame, *keys: str) -> DataFrame:
    return frequencies(summary, *keys, name="acct_ct")


def mean_tenure_by_group(summary: DataFrame) -> DataFrame:
    """Mean tenure in years. Days are added as integers, so row order has no effect."""
    days = ratio(F.sum("acct_tenure_days"), F.count("acct_tenure_days"))
    return group_present(summary, "acct_txn_group").agg(
        dates.years_in(days).alias("mean_tenure_years")
    )


def payment_summary(summary: DataFrame, *keys: str) -> DataFrame:
    """Revenue, purchases and accounts per payment type (and flag)."""
    return (
        group_present(summary, *keys)
        .agg(
            money_sum(F.col("total_revenue").cast("decimal(18,2)")).alias("total_revenue"),
            F.sum("total_txn").alias("total_txn"),
            F.count("acct_id").alias("total_acct_ct"),
        )
        .withColumn("avg_txn", ratio("total_txn", "total_acct_ct"))
    )


def accounts_by_payment_and_paid(summary: DataFrame, outliers: DataFrame) -> DataFrame:
    """Accounts per payment type and paid flag, outliers left out, with the share in the type."""
    kept = without_ids(summary, outliers, "acct_id")
    counted = group_present(kept, "payment_type", "paid_acct_flag").agg(
        F.countDistinct("acct_id").alias("no_txn_acct_ct")
    )
    return counted.withColumn("acct_share", share_of_group("no_txn_acct_ct", "payment_type"))


def week_account_activity(final: DataFrame, account: DataFrame, week) -> DataFrame:
    """Every account with its revenue and purchases of one week."""
    active = group_present(in_week(final, week), "acct_id").agg(
        money_sum().alias("total_revenue"), rows().alias("total_txn")
    )
    bought = F.col("total_txn").isNotNull()
    paid = (
        F.when(F.col("total_revenue") > 0, PURCHASED).when(bought, FREE_ONLY).otherwise(DORMANT)
    )
    return lookup(account_dimension(account), active, "acct_id").select(
        "acct_id",
        "account_create_dt",
        "payment_type",
        F.when(bought, F.lit(week).cast("date")).alias("first_day_of_the_week"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        F.coalesce("total_txn", F.lit(0)).alias("total_txn"),
        paid.alias("paid_acct_flag"),
        F.when(bought, ACTIVE).otherwise(DORMANT).alias("no_txn_flag"),
    )
