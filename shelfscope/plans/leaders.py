"""Weekly app ranks and leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import money_sum, rows
from shelfscope.operators.grouping import group_present
from shelfscope.operators.ordering import top_per_group, with_min_ranks
from shelfscope.operators.ranges import Keep
from shelfscope.sources.kept import checkpointed

WEEK = "first_day_of_the_week"


def _category_weeks(counted: DataFrame) -> DataFrame:
    """Sales of every category and week with their ranks: one row per category and week.

    The plain rank counts the app rows of better categories, the dense one the categories.
    """
    best_first = Window.partitionBy(WEEK).orderBy(F.desc("category_weekly_sales"))
    better = F.sum("app_ct").over(best_first.rangeBetween(Window.unboundedPreceding, 0))
    equal = F.sum("app_ct").over(Window.partitionBy(WEEK, "category_weekly_sales"))
    return (
        counted.groupBy(WEEK, "category_name")
        .agg(
            F.sum(F.col("app_weekly_sales").cast("decimal(18,2)"))
            .cast("double")
            .alias("category_weekly_sales"),
            rows().alias("app_ct"),
        )
        .select(
            WEEK,
            "category_name",
            "category_weekly_sales",
            (better - equal + 1).cast("int").alias("category_weekly_sales_rank"),
            F.dense_rank().over(best_first).alias("category_weekly_sales_dense_rank"),
        )
    )


def app_week_counts(final: DataFrame) -> DataFrame:
    """Sales, buyers and purchases of every app and week: what the ranks are made from."""
    return group_present(final, WEEK, "app_name", "category_name").agg(
        money_sum().alias("app_weekly_sales"),
        F.countDistinct("acct_id").alias("app_active_acct_ct"),
        rows().alias("app_weekly_transaction_ct"),
    )


def app_week(counts: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """Apps by week with ranks in the week and in the category of the week.

    ``category_weekly_sales_rank`` ranks app rows, so it skips by the number of apps of a
    category; the dense rank next to it numbers the categories.
    """
    week, category = [WEEK], [WEEK, "category_name"]
    ranked = with_min_ranks(
        counts,
        {
            "app_weekly_sales": {
                "app_weekly_sales_rank": week,
                "app_weekly_sales_rank_category": category,
            },
            "app_weekly_transaction_ct": {
                "app_weekly_transaction_ct_rank": week,
                "app_weekly_transaction_ct_rank_category": category,
            },
        },
        keep,
    )
    return ranked.join(_category_weeks(counts), category)


def latest_week(ranked: DataFrame) -> DataFrame:
    """Rows of the last week."""
    return ranked.filter(F.col(WEEK) == ranked.agg(F.max(WEEK)).scalar())


def _either_within(k: int, first: str, second: str) -> Column:
    return (F.col(first) <= k) | (F.col(second) <= k)


def week_leaders(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Apps of the last week among the first ``k`` by sales or by purchases; ties stay."""
    return latest_week(ranked).filter(
        _either_within(k, "app_weekly_sales_rank", "app_weekly_transaction_ct_rank")
    )


def category_leaders(ranked: DataFrame, k: int = 5, category: str | None = None) -> DataFrame:
    """Leaders of the last week within each category, best category first."""
    best = latest_week(ranked).filter(
        _either_within(
            k, "app_weekly_sales_rank_category", "app_weekly_transaction_ct_rank_category"
        )
    )
    if category is not None:
        best = best.filter(F.col("category_name") == category)
    return best.orderBy(
        "category_weekly_sales_rank", "app_weekly_sales_rank_category", "app_name"
    )


def week_top_sales(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best apps by sales of each week and category, ties included, from ``app_week_counts``."""
    return top_per_group(counts, k, [WEEK, "category_name"], "app_weekly_sales", "sales_rank")


def day_top_apps(final: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` apps of highest revenue of each day, ties included.

    A day with a third of all purchases is aggregated by app like any other, and only its best apps
    of each partition meet.
    """
    counted = group_present(final, "transaction_dt", "parent_app_content_id", "app_name").agg(
        money_sum().alias("revenue_by_app"), rows().alias("txn_by_app")
    )
    return top_per_group(counted, k, ["transaction_dt"], "revenue_by_app", "revenue_rank")
