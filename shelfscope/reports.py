"""Every market report by name: what a user runs, and what the checks run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.market import Market
from shelfscope.operators.checks import distinct_values
from shelfscope.operators.ordering import last_rows, top_rows
from shelfscope.operators.profile import describe
from shelfscope.plans import (
    accounts,
    experiments,
    leaders,
    pricing,
    quality,
    rollups,
    segments,
    subscriptions,
    trends,
)
from shelfscope.schemas import TRANSACTION
from shelfscope.sources.files import read_table, write_table
from shelfscope.sources.kept import Profile

Report = Callable[[Market], DataFrame]

# Name of each output table and the report behind it.
OUTPUTS = {
    "paid": "paid_share",
    "account_summary": "account_summary",
    "tenure_txn": "tenure_activity",
    "performance_daily": "performance_daily",
    "performance_daily_category": "performance_daily_category",
    "performance_weekday_overall": "performance_weekday_overall",
    "performance_week": "performance_week",
    "performance_week_category": "performance_week_category",
    "performance_weekday": "performance_weekday",
    "app_week": "app_week",
    "category_summary": "category_summary",
    "device_summary": "device_summary",
    "app_device": "apps_by_device",
    "device_summary2": "device_summary_both",
    "payment1": "payment_summary",
    "payment2": "payment_paid_summary",
    "app_summary": "app_content_summary",
    "subscription_summary": "subscription_summary",
    "subscription_category": "subscription_category",
    "subscription_pivot_summary": "repeat_purchase_by_type",
    "repeat_purchase_summary": "repeat_purchase_summary",
}


def round_trip(market: Market, df: DataFrame, fmt: str) -> DataFrame:
    """Write a table into the market's folder, at once, and scan it again with its schema.

    CSV columns are written in reverse order, as files name their columns in any.
    """
    path = f"{market.folder}/round-trip-{uuid.uuid4().hex}"
    write_table(df.select(*reversed(df.columns)) if fmt == "csv" else df, path, fmt)
    return read_table(df.sparkSession, path, df.schema, fmt)


def _fact_reports() -> dict[str, Report]:
    def by_day(m: Market) -> DataFrame:
        """Taken in twice: what came before a day, and then all rows, late ones and copies with it."""
        sold = m.roles.transaction
        return m.distinct_by_day(sold.where(F.col("create_dt") < F.lit(m.rules.last_week)), sold)

    return {
        "distinct_by_day": by_day,
        "app_dimension": lambda m: m.app_dimension,
        "transaction_fact": lambda m: m.transaction_fact,
        "final_fact": lambda m: m.final,
        "final_by_account": lambda m: m.final_by_account,
        "resolution_report": lambda m: quality.resolution_report(m.resolved),
        "apps_without_content": lambda m: quality.apps_without_content(m.app_dimension),
    }


def _account_reports() -> dict[str, Report]:
    def bars(measure: str, bins: int, with_zero: bool, limit: str | None = None) -> Report:
        def drawn(m: Market) -> DataFrame:
            ends = (0, getattr(m.rules, limit)) if limit else (None, None)
            return accounts.measure_histogram(m.account_summary, measure, bins, with_zero, *ends)

        return drawn

    def trimmed(active_only: bool) -> Report:
        return lambda m: accounts.trimmed_summary(
            m.account_summary, m.rules.max_revenue, m.rules.max_transactions, active_only
        )

    return {
        "revenue_by_account_category": lambda m: accounts.revenue_by_account_category(
            m.resolved, m.categories
        ),
        "account_summary": lambda m: m.account_summary,
        "account_summary_recut": lambda m: accounts.recut_account_tenure(
            m.account_summary, m.final
        ),
        "outlier_accounts": lambda m: m.outliers,
        "extreme_accounts": lambda m: accounts.extreme_accounts(m.account_summary),
        "active_share": lambda m: accounts.active_share(m.account_summary),
        "paid_share": lambda m: accounts.paid_share(m.account_summary),
        "spend_histogram": bars("total_revenue", 40, True),
        "spend_histogram_buyers": bars("total_revenue", 40, False),
        "spend_histogram_low": bars("total_revenue", 40, False, "zoom_revenue"),
        "spend_histogram_within": bars("total_revenue", 30, False, "max_revenue"),
        "txn_histogram": bars("total_txn", 40, True),
        "txn_histogram_active": bars("total_txn", 40, False),
        "txn_histogram_low": bars("total_txn", 40, False, "zoom_transactions"),
        "txn_histogram_within": bars("total_txn", 30, False, "max_transactions"),
        "transaction_statistics": lambda m: describe(m.resolved, ["price", "category_id"], m.step),
        "account_statistics": lambda m: describe(m.account_summary, keep=m.step),
        "final_statistics": lambda m: describe(m.final, keep=m.step),
        "trimmed_summary": trimmed(False),
        "trimmed_summary_active": trimmed(True),
        "tenure_by_payment": lambda m: accounts.tenure_counts(m.account_summary, "payment_type"),
        "tenure_by_group": lambda m: accounts.tenure_counts(m.account_summary, "acct_txn_group"),
        "activity_by_payment": lambda m: accounts.account_counts(
            m.account_summary, "payment_type", "no_txn_flag"
        ),
        "payment_by_group": lambda m: accounts.account_counts(
            m.account_summary, "acct_txn_group", "payment_type"
        ),
        "mean_tenure_by_group": lambda m: accounts.mean_tenure_by_group(m.account_summary),
        "accounts_by_payment_and_paid": lambda m: accounts.accounts_by_payment_and_paid(
            m.account_summary, m.outliers
        ),
        "payment_summary": lambda m: accounts.payment_summary(m.account_summary, "payment_type"),
        "payment_paid_summary": lambda m: accounts.payment_summary(
            m.account_summary, "payment_type", "paid_acct_flag"
        ),
        "week_account_activity": lambda m: m.week_activity,
        "week_paid_share": lambda m: accounts.paid_share(m.week_activity),
    }


def _trend_reports() -> dict[str, Report]:
    def latest(m: Market) -> DataFrame:
        keys = ["first_day_of_the_week", "category_name"]
        return last_rows(m.weekly_category, 15, [F.asc(k) for k in keys], [F.desc(k) for k in keys])

    def daily_category(m: Market) -> DataFrame:
        if m.keeps:
            return trends.performance_daily(rollups.daily_category(m.rollups))
        return trends.performance_daily_category(m.final)

    def weekday_overall(m: Market) -> DataFrame:
        if m.keeps:
            return rollups.performance_weekday_overall(m.rollups)
        return trends.performance_weekday_overall(m.final, m.daily)

    def week(m: Market) -> DataFrame:
        return rollups.performance_week(m.rollups) if m.keeps else trends.performance_week(m.final)

    def months(m: Market, exclude_days: Sequence = ()) -> DataFrame:
        if m.keeps:
            return rollups.performance_month(m.rollups, exclude_days)
        return trends.performance_month(m.final, exclude_days)

    return {
        "latest_category_weeks": latest,
        "approximate_distinct": lambda m: rollups.distinct_check(m.rollups),
        "price_quantiles": lambda m: rollups.quantile_check(m.rollups, m.final, keep=m.step),
        "txn_by_month": lambda m: trends.txn_by(m.final, "transaction_year_month"),
        "txn_by_price_band": lambda m: trends.txn_by(m.final, "price_band"),
        "txn_by_tenure": lambda m: trends.txn_by_tenure(m.final),
        "paid_txn_by_tenure": lambda m: trends.txn_by_tenure(m.final, paid_only=True),
        "tenure_activity": lambda m: trends.tenure_activity(m.final),
        "txn_group_summary": lambda m: trends.txn_group_summary(m.final),
        "performance_daily": lambda m: trends.performance_daily(m.daily),
        "performance_daily_category": daily_category,
        "day_app_leaders": lambda m: trends.day_app_leaders(m.final, m.rules.spike_day),
        "daily_app_performance": lambda m: trends.daily_app_performance(m.final),
        "day_movers_txn": lambda m: trends.day_movers(m.final, m.rules.spike_day, "txn"),
        "day_movers_revenue": lambda m: trends.day_movers(m.final, m.rules.spike_day, "revenue"),
        "performance_weekday_overall": weekday_overall,
        "performance_week": week,
        "performance_week_category": lambda m: m.weekly_category,
        "week_category_pivot": lambda m: trends.week_category_pivot(
            m.weekly_category, [m.rules.short_week], m.categories
        ),
        "performance_weekday": lambda m: trends.performance_weekday(m.daily),
        "week_snapshot_category": lambda m: trends.week_snapshot(
            m.weekly_category,
            m.rules.last_week,
            "category_name",
            ["weekly_sales_increase_rate", "weekly_transaction_ct_increase_rate"],
        ),
        "week_snapshot_weekday": lambda m: trends.week_snapshot(
            trends.performance_weekday(m.daily),
            m.rules.last_week,
            "transaction_weekday_nm",
            ["wow_sales_increase_rate", "wow_transaction_ct_increase_rate", "wow_active_acct_ct"],
        ),
        "app_week": lambda m: m.app_week,
        "week_top_sales": lambda m: leaders.week_top_sales(m.app_week_counts),
        "day_top_apps": lambda m: leaders.day_top_apps(m.final),
        "week_leaders": lambda m: leaders.week_leaders(m.app_week),
        "category_leaders": lambda m: leaders.category_leaders(m.app_week),
        "category_leaders_games": lambda m: leaders.category_leaders(m.app_week, category="Games"),
        "performance_month": months,
        "performance_month_without_spike": lambda m: months(m, [m.rules.spike_day]),
    }


def _segment_reports() -> dict[str, Report]:
    return {
        "category_summary": lambda m: segments.category_summary(m.final),
        "txn_by_category": lambda m: trends.count_share(m.final, "category_name"),
        "device_summary": lambda m: segments.device_summary(m.final),
        "apps_by_device": lambda m: segments.apps_by_device(m.app_dimension),
        "device_summary_both": lambda m: segments.device_summary_both(m.final),
        "txn_by_payment": lambda m: segments.txn_by_payment(m.final),
        "txn_by_content_type": lambda m: segments.txn_by_content_type(m.final),
        "app_content_summary": lambda m: segments.app_content_summary(m.app_dimension),
        "tenure_performance": lambda m: segments.tenure_performance(m.final),
        "tenure_price_performance": lambda m: segments.tenure_price_performance(m.final),
        "devices_per_account": lambda m: segments.devices_per_account(m.final),
        "device_count_values": lambda m: distinct_values(
            segments.devices_per_account(m.final), "device_ct"
        ),
        "content_first_seen": lambda m: segments.content_first_seen(m.final),
        "content_first_days": lambda m: distinct_values(
            segments.content_first_seen(m.final), "first_txn_dt"
        ),
        "price_days": lambda m: pricing.price_days(m.final),
        "regular_price": lambda m: m.regular_price,
        "priced_transactions": lambda m: pricing.priced_transactions(m.final, m.regular_price),
        "priced_by_content": lambda m: m.priced_by_content,
        "promotions": lambda m: pricing.promotions(m.final, m.regular_price),
    }


def _subscription_reports() -> dict[str, Report]:
    def test(category: str) -> Report:
        return lambda m: experiments.repeat_test(
            m.content_repeats, m.app_dimension, category, m.rules.z
        )

    def least_bought(m: Market) -> DataFrame:
        order = [F.asc("transaction_ct"), F.asc("content_id"), F.asc("inapp_content_type")]
        return top_rows(subscriptions.subscription_content(m.subscription), 5, order)

    return {
        "subscription_transactions": lambda m: m.subscription,
        "subscription_summary": lambda m: subscriptions.subscription_summary(
            m.subscription, subscriptions.period_share(m.activity), m.rules.retention
        ),
        "subscription_category": lambda m: subscriptions.subscription_category(
            m.subscription, subscriptions.period_share(m.activity), m.rules.retention
        ),
        "subscription_content": lambda m: subscriptions.subscription_content(m.subscription),
        "least_bought_contents": least_bought,
        "monthly_purchase_matrix": lambda m: m.purchase_matrix,
        "repeat_purchase_by_type": lambda m: subscriptions.repeat_purchase_by_type(
            m.content_repeats, m.app_dimension
        ),
        "repeat_by_content_utilities": lambda m: subscriptions.repeat_by_content(
            m.content_repeats, m.app_dimension, "Utilities"
        ),
        "repeat_purchase_summary": lambda m: subscriptions.repeat_purchase_summary(
            m.final, m.months
        ),
        "payment_test": lambda m: experiments.payment_test(m.account_summary, m.rules.z),
        "content_test_txn": lambda m: experiments.content_test(
            subscriptions.subscription_content(m.subscription), "transaction_ct", m.rules.z
        ),
        "content_test_revenue": lambda m: experiments.content_test(
            subscriptions.subscription_content(m.subscription), "total_revenue", m.rules.z
        ),
        "repeat_test_entertainment": test("Entertainment"),
        "repeat_test_utilities": test("Utilities"),
        "repeat_test_photos_videos": test("Photos & Videos"),
    }


# Derived tables whose columns the quality reports list.
PROFILED = ["app_dimension", "transaction_fact", "account_summary", "final", "week_activity"]


def profiles(market: Market) -> dict[str, Profile]:
    return {name: market.profile(name) for name in PROFILED}


def _quality_reports() -> dict[str, Report]:
    return {
        "duplicate_report": lambda m: quality.duplicate_report(m.roles),
        "null_report": lambda m: quality.null_report(m.roles, profiles(m)),
        "column_report": lambda m: quality.column_report(m.roles, profiles(m)),
        "ambiguous_app_names": lambda m: quality.ambiguous_app_names(m.roles),
        "transaction_period": lambda m: quality.transaction_period(m.roles),
        "device_names": lambda m: distinct_values(m.roles.device, "device_name"),
        "category_names": lambda m: distinct_values(m.roles.category, "category_name"),
        "content_types": lambda m: distinct_values(m.roles.inapp, "type"),
        "input_cardinalities": lambda m: quality.input_cardinalities(m.roles),
        "orphan_accounts": lambda m: quality.orphan_accounts(m.resolved, m.roles),
        "row_count_report": lambda m: quality.row_count_report(
            m.roles, m.resolved, m.account_summary
        ),
        "csv_round_trip": lambda m: round_trip(
            m, trends.performance_daily(m.daily), "csv"
        ),
        "parquet_round_trip": lambda m: round_trip(m, m.weekly_category, "parquet"),
        "csv_input_round_trip": lambda m: round_trip(
            m, m.roles.transaction.select(*TRANSACTION.names), "csv"
        ),
    }


def reports() -> dict[str, Report]:
    return {
        **_fact_reports(),
        **_account_reports(),
        **_trend_reports(),
        **_segment_reports(),
        **_subscription_reports(),
        **_quality_reports(),
    }


def write_outputs(market: Market, folder: str, fmt: str = "csv") -> dict[str, str]:
    """Write every output table to a folder of its own; gives their paths."""
    known = reports()
    paths = {output: f"{folder}/{output}" for output in OUTPUTS}
    for output, report in OUTPUTS.items():
        write_table(known[report](market), paths[output], fmt)
    return paths
