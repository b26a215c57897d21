"""Performance by day, weekday, week and month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.dates import (
    days_seen_in_month,
    days_seen_in_week,
    week_start,
    weekday_name,
    weekday_number,
    year_month,
)
from shelfscope.functions.numbers import money_sum, ratio, rows
from shelfscope.operators.grouping import (
    fill_bands,
    group_present,
    share_of_total,
    spread_sum,
    value_counts,
)
from shelfscope.operators.joins import lookup
from shelfscope.operators.ordering import top_rows, with_change, with_previous
from shelfscope.schemas import CATEGORY_COLUMNS, TENURE_LABELS


def _day(value):
    return F.lit(value).cast("date")


def on_day(final: DataFrame, day) -> DataFrame:
    """Purchases of one day. Naming the month too skips the other months' folders."""
    wanted = _day(day)
    return final.filter(
        (F.col("transaction_dt") == wanted)
        & (F.col("transaction_year_month") == year_month(wanted))
    )


def up_to(final: DataFrame, day) -> DataFrame:
    """Purchases until the end of a day, for changes that only look back from it."""
    wanted = _day(day)
    return final.filter(
        (F.col("transaction_dt") <= wanted)
        & (F.col("transaction_year_month") <= year_month(wanted))
    )


def in_week(final: DataFrame, week) -> DataFrame:
    """Purchases of the week that starts on a Monday, read from its one or two months."""
    first, last = _day(week), F.date_add(_day(week), 6)
    return final.filter(
        (F.col("first_day_of_the_week") == first)
        & F.col("transaction_dt").between(first, last)
        & F.col("transaction_year_month").between(year_month(first), year_month(last))
    )


def txn_by(final: DataFrame, column: str) -> DataFrame:
    """Purchases per value, most frequent first."""
    return value_counts(final, column, "transaction_ct")


def txn_by_tenure(final: DataFrame, paid_only: bool = False) -> DataFrame:
    """Purchases per tenure band, with empty bands."""
    kept = final.filter(F.col("free_transaction_flag") != 1) if paid_only else final
    counted = kept.groupBy("tenure_band").agg(rows().alias("transaction_ct"))
    return fill_bands(counted, {"tenure_band": TENURE_LABELS})


def tenure_activity(final: DataFrame) -> DataFrame:
    counted = final.groupBy("tenure_band").agg(
        F.countDistinct("acct_id").alias("acct_ct"), rows().alias("txn")
    )
    filled = fill_bands(counted, {"tenure_band": TENURE_LABELS})
    return filled.withColumn("avg_txn", ratio("txn", "acct_ct"))


def txn_group_summary(final: DataFrame) -> DataFrame:
    return (
        group_present(final, "acct_txn_group")
        .agg(
            F.countDistinct("acct_id").alias("acct_ct"),
            money_sum().alias("total_revenue"),
            rows().alias("total_txn"),
        )
        .withColumn("avg_revenue", ratio("total_revenue", "acct_ct"))
        .withColumn("avg_txn", ratio("total_txn", "acct_ct"))
    )


def daily_counts(final: DataFrame, *keys: str) -> DataFrame:
    """Measures by day (and more keys), with the exact total: what the daily reports derive from."""
    return group_present(final, "transaction_dt", *keys).agg(
        F.countDistinct("acct_id").alias("active_acct_ct"),
        F.countDistinct("parent_app_content_id").alias("active_unique_app"),
        F.sum("price").alias("sales"),
        F.sum("free_transaction_flag").alias("free_transaction_ct"),
        rows().alias("transaction_ct"),
    )


def performance_daily(daily: DataFrame) -> DataFrame:
    """Measures and means per account of each row of ``daily_counts``."""
    per_account = {
        "avg_free_transaction_ct_per_acct": "free_transaction_ct",
        "avg_paid_transaction_ct_per_acct": "paid_transaction_ct",
        "avg_transaction_ct_per_acct": "transaction_ct",
        "avg_sales_per_acct": "daily_sales",
    }
    return (
        daily.withColumn("daily_sales", F.coalesce("sales", F.lit(0)).cast("double"))
        .withColumn("paid_transaction_ct", F.col("transaction_ct") - F.col("free_transaction_ct"))
        .withColumns({new: ratio(old, "active_acct_ct") for new, old in per_account.items()})
        .drop("sales")
    )


def performance_daily_category(final: DataFrame) -> DataFrame:
    return performance_daily(daily_counts(final, "category_name")).drop("active_unique_app")


def day_app_leaders(final: DataFrame, day, k: int | None = 5) -> DataFrame:
    """Apps of one day by revenue, then purchases; all of them without ``k``."""
    counted = group_present(on_day(final, day), "parent_app_content_id", "app_name").agg(
        F.countDistinct("acct_id").alias("active_acct"),
        money_sum().alias("revenue_by_app"),
        rows().alias("txn_by_app"),
    )
    order = [
        F.desc_nulls_last("revenue_by_app"),
        F.desc_nulls_last("txn_by_app"),
        F.asc("parent_app_content_id"),
        F.asc("app_name"),
    ]
    return top_rows(counted, k, order) if k else counted


def daily_app_performance(final: DataFrame) -> DataFrame:
    """Apps by day with the change against the app's previous active day."""
    app = ["parent_app_content_id", "app_name"]
    counted = group_present(final, *app, "transaction_dt").agg(
        F.countDistinct("acct_id").alias("active_acct"),
        money_sum().alias("revenue_by_app"),
        rows().alias("txn_by_app"),
    )
    before = with_previous(
        counted,
        app,
        "transaction_dt",
        {"txn_by_app": "yesterday_txn_by_app", "revenue_by_app": "yesterday_revenue_by_app"},
    )
    return _app_changes(before)


def _app_changes(before: DataFrame) -> DataFrame:
    changed = with_change(
        before, "txn_by_app", "yesterday_txn_by_app", "app_txn_change_rate", "app_txn_change"
    )
    return with_change(
        changed,
        "revenue_by_app",
        "yesterday_revenue_by_app",
        "app_revenue_change_rate",
        "app_revenue_change",
    )


def day_movers(final: DataFrame, day, by: str, k: int = 10) -> DataFrame:
    """Apps that gained most on one day; ``by`` is ``txn`` or ``revenue``.

    Accounts are told apart on that day alone; of earlier days, plain totals are enough.
    """
    app = ["parent_app_content_id", "app_name"]
    order = [
        F.desc_nulls_last(f"app_{by}_change"),
        F.desc_nulls_last(f"app_{by}_change_rate"),
        F.asc("parent_app_content_id"),
        F.asc("app_name"),
    ]
    today = day_app_leaders(final, day, k=None).withColumn("transaction_dt", _day(day))
    earlier = (
        group_present(up_to(final, day), *app, "transaction_dt")
        .agg(money_sum().alias("revenue"), rows().alias("txn"))
        .filter(F.col("transaction_dt") < _day(day))
        .groupBy(*app)
        .agg(F.max(F.struct("transaction_dt", "txn", "revenue")).alias("before"))
    )
    joined = lookup(today, earlier, app).select(
        *app,
        "transaction_dt",
        "active_acct",
        "revenue_by_app",
        "txn_by_app",
        F.col("before.txn").alias("yesterday_txn_by_app"),
        F.col("before.revenue").alias("yesterday_revenue_by_app"),
    )
    return top_rows(_app_changes(joined), k, order)


def performance_weekday_overall(final: DataFrame, daily: DataFrame) -> DataFrame:
    """Weekdays over the whole period.

    Sums and days come from ``daily_counts``. The two distinct counts go through the purchases
    one by one, as together they would multiply the rows.
    """
    weekday = ["transaction_weekday", "transaction_weekday_nm"]
    day = F.col("transaction_dt")
    totals = (
        daily.groupBy(weekday_number(day).alias(weekday[0]), weekday_name(day).alias(weekday[1]))
        .agg(
            F.coalesce(F.sum("sales"), F.lit(0)).cast("double").alias("total_sales"),
            rows().alias("active_days"),
            F.sum("transaction_ct").alias("total_transaction_ct"),
        )
    )

    def distinct(column: str, name: str) -> DataFrame:
        return group_present(final, *weekday).agg(F.countDistinct(column).alias(name))

    joined = totals.join(distinct("acct_id", "purchased_acct_ct"), weekday).join(
        distinct("parent_app_content_id", "purchased_unique_app"), weekday
    )
    return daily_means(joined, "total_transaction_ct", "total_sales").orderBy("transaction_weekday")


def daily_means(counted: DataFrame, transactions: str, sales: str) -> DataFrame:
    """Purchases and sales per active day."""
    averaged = counted.withColumn("avg_daily_transaction_ct", ratio(transactions, "active_days"))
    return averaged.withColumn("avg_daily_sales", ratio(sales, "active_days"))


def _weekly(final: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = group_present(final, "first_day_of_the_week", *keys).agg(
        money_sum().alias("weekly_sales"),
        F.countDistinct("acct_id").alias("active_acct_ct"),
        days_seen_in_week("transaction_dt").alias("active_days"),
        rows().alias("weekly_transaction_ct"),
    )
    return weekly_changes(counted, keys)


def weekly_changes(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means per active day, and the change against the previous week, of a row per week and key."""
    before = with_previous(
        daily_means(counted, "weekly_transaction_ct", "weekly_sales"),
        keys,
        "first_day_of_the_week",
        {
            "weekly_sales": "previous_week_sales",
            "weekly_transaction_ct": "previous_week_transaction_ct",
        },
    )
    changed = with_change(
        before, "weekly_sales", "previous_week_sales", "weekly_sales_increase_rate"
    )
    return with_change(
        changed,
        "weekly_transaction_ct",
        "previous_week_transaction_ct",
        "weekly_transaction_ct_increase_rate",
    )


def performance_week(final: DataFrame) -> DataFrame:
    """Weeks with the change against the previous one: a window over one row per week."""
    return _weekly(final, [])


def performance_week_category(final: DataFrame) -> DataFrame:
    return _weekly(final, ["category_name"])


def week_category_pivot(
    weekly_category: DataFrame,
    skip_weeks: Sequence = (),
    categories: Mapping[str, str] = CATEGORY_COLUMNS,
) -> DataFrame:
    """Purchases per week, one column per category; categories without any stay missing."""
    kept = weekly_category
    for week in skip_weeks:
        kept = kept.filter(~F.col("first_day_of_the_week").eqNullSafe(_day(week)))
    return spread_sum(
        kept,
        ["first_day_of_the_week"],
        "category_name",
        categories,
        "weekly_transaction_ct",
        fill=None,
    )


def performance_weekday(daily: DataFrame) -> DataFrame:
    """Weekdays by week with the change against the same weekday of the previous week.

    A weekday of a week is one day, so ``daily_counts`` has all measures.
    """
    day = F.col("transaction_dt")
    counted = daily.select(
        week_start(day).alias("first_day_of_the_week"),
        weekday_name(day).alias("transaction_weekday_nm"),
        F.coalesce("sales", F.lit(0)).cast("double").alias("daily_sales"),
        "active_acct_ct",
        F.col("transaction_ct").alias("daily_transaction_ct"),
    )
    before = with_previous(
        counted,
        ["transaction_weekday_nm"],
        "first_day_of_the_week",
        {
            "active_acct_ct": "previous_weekday_active_acct_ct",
            "daily_sales": "previous_weekday_sales",
            "daily_transaction_ct": "previous_weekday_transaction_ct",
        },
    )
    changed = with_change(
        before, "active_acct_ct", "previous_weekday_active_acct_ct", "wow_active_acct_ct"
    )
    changed = with_change(
        changed, "daily_sales", "previous_weekday_sales", "wow_sales_increase_rate"
    )
    return with_change(
        changed,
        "daily_transaction_ct",
        "previous_weekday_transaction_ct",
        "wow_transaction_ct_increase_rate",
    )


def week_snapshot(weekly: DataFrame, week, key: str, rates: Sequence[str]) -> DataFrame:
    """Change rates of one week, by category or weekday."""
    return weekly.filter(F.col("first_day_of_the_week") == _day(week)).select(key, *rates)


def performance_month(final: DataFrame, exclude_days: Sequence = ()) -> DataFrame:
    kept = final
    for day in exclude_days:
        kept = kept.filter(~F.col("transaction_dt").eqNullSafe(_day(day)))
    counted = group_present(kept, "transaction_year_month").agg(
        money_sum().alias("monthly_sales"),
        F.countDistinct("acct_id").alias("active_acct_ct"),
        F.countDistinct("parent_app_content_id").alias("purchased_unique_app"),
        days_seen_in_month("transaction_dt").alias("active_days"),
        rows().alias("transaction_ct"),
    )
    return daily_means(counted, "transaction_ct", "monthly_sales")


def count_share(final: DataFrame, column: str) -> DataFrame:
    """Purchases per value and their share."""
    counted = group_present(final, column).agg(rows().alias("transaction_ct"))
    return counted.withColumn("transaction_share", share_of_total("transaction_ct"))
