"""Quality reports over the input tables and the joins of the facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators import checks
from shelfscope.operators.joins import row_counts
from shelfscope.plans.facts import distinct_transactions
from shelfscope.sources.files import Roles
from shelfscope.sources.kept import Profile


def duplicate_report(roles: Roles) -> DataFrame:
    """Rows, distinct rows and copies of every input."""
    return checks.labelled(
        {name: checks.duplicate_stats(df) for name, df in roles.tables().items()}, "table_name"
    )


def null_report(roles: Roles, derived: Mapping[str, Profile] = {}) -> DataFrame:
    """Missing values per column of every input, by a scan, and of derived tables, as their writes saw them."""
    scanned = checks.labelled({n: checks.null_profile(df) for n, df in roles.tables().items()}, "table_name")
    seen = checks.profile_rows(scanned.sparkSession, derived)
    return scanned.unionByName(seen.select(*scanned.columns))


def column_report(roles: Roles, derived: Mapping[str, Profile] = {}) -> DataFrame:
    """Types and present values, likewise."""
    scanned = checks.labelled({n: checks.column_profile(df) for n, df in roles.tables().items()}, "table_name")
    seen = checks.profile_rows(scanned.sparkSession, derived)
    return scanned.unionByName(seen.select(*scanned.columns))


def ambiguous_app_names(roles: Roles) -> DataFrame:
    return checks.ambiguous_names(roles.app, "app_name", "content_id")


def transaction_period(roles: Roles) -> DataFrame:
    return checks.period(roles.transaction, "create_dt")


def input_cardinalities(roles: Roles) -> DataFrame:
    """Distinct keys and values of the inputs, one row per table and column."""
    wanted = {
        "app": ["content_id", "app_name"],
        "inapp": ["parent_app_content_id", "content_id", "type"],
        "category": ["category_name"],
        "device": ["device_name"],
    }
    tables = roles.tables()
    return checks.labelled(
        {name: checks.distinct_counts(tables[name], columns) for name, columns in wanted.items()},
        "table_name",
    )


def apps_without_content(app_dim: DataFrame) -> DataFrame:
    return app_dim.filter(F.col("content_id").isNull()).agg(
        F.countDistinct("parent_app_content_id").alias("app_ct")
    )


def orphan_accounts(resolved: DataFrame, roles: Roles) -> DataFrame:
    """Accounts that buy but are missing in the account table."""
    return checks.orphan_keys(resolved, roles.account, "acct_id")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """How many purchases found a content, only an app, or nothing."""
    found = (
        F.when(F.col("content_id").isNotNull(), "content")
        .when(F.col("parent_app_content_id").isNotNull(), "app")
        .otherwise("unresolved")
    )
    return resolved.groupBy(found.alias("resolution")).agg(
        F.count(F.lit(1)).alias("transaction_ct")
    )


def row_count_report(roles: Roles, resolved: DataFrame, summary: DataFrame) -> DataFrame:
    """Whether de-duplicated purchases and accounts keep their number through the joins."""
    transactions = distinct_transactions(roles.transaction)
    # A left join adds rows only where its right key is not unique; those keys are few or none.
    copies = roles.account.groupBy("acct_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    added = resolved.select("acct_id").join(copies, "acct_id")
    enriched = resolved.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before",
        (
            F.col("rows_before")
            + added.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
        ).alias("rows_after"),
    )
    steps = {
        "resolve": row_counts(transactions, resolved),
        "enrich": enriched.withColumn(
            "same_count", F.col("rows_before") == F.col("rows_after")
        ),
        "account": row_counts(roles.account, summary),
    }
    return checks.labelled(steps, "step")

