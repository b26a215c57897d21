"""Every registered query against its SQL counterpart, and what its plan may not contain."""

import re
from pathlib import Path

import __spark_entry__ as registered
import pytest
from oracle_check import connect, differences
from shelfscope.reports import reports

NAMES = sorted(reports())

# Reports that ended before their own work where the region keys have 64 bits or the master is not local.
ENDED_EARLY = [
    "account_summary",
    "account_summary_recut",
    "accounts_by_payment_and_paid",
    "active_share",
    "activity_by_payment",
    "ambiguous_app_names",
    "app_content_summary",
    "app_dimension",
    "app_week",
    "approximate_distinct",
    "apps_by_device",
    "apps_without_content",
    "category_leaders",
    "category_leaders_games",
    "category_names",
    "category_summary",
    "column_report",
    "content_first_days",
    "content_first_seen",
    "content_test_revenue",
    "content_test_txn",
]


@pytest.fixture(scope="module")
def oracle(small):
    return connect(small)


def test_every_query_has_its_sql():
    assert set(reports()) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, oracle, name):
    df = registered.queries()[name](spark, small)
    assert differences(df, oracle, registered.oracle_sql()[name]) == []


@pytest.fixture(scope="module")
def wide(spark, small, tmp_path_factory):
    """The small tables, with region keys of 64 bits."""
    folder = tmp_path_factory.mktemp("wide")
    for path in Path(small).glob("*.parquet"):
        if path.stem in ("nation", "region"):
            df = spark.read.parquet(str(path))
            keys = {c: df[c].cast("long") for c in df.columns if c.endswith("key")}
            df.withColumns(keys).write.parquet(str(folder / path.name))
        else:
            (folder / path.name).symlink_to(path)
    return str(folder)


@pytest.mark.parametrize("name", ENDED_EARLY)
def test_query_on_a_cluster_with_wide_region_keys(spark, wide, name, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    df = registered.queries()[name](spark, wide)
    assert differences(df, connect(wide), registered.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_python_and_no_cross_join(spark, small, name):
    df = registered.queries()[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert not re.search(node, plan), node


def test_entry_is_the_weekly_ranking(spark):
    df = registered.entry(spark)
    assert "app_weekly_sales_rank" in df.columns
    assert df.count() > 0


def test_fact_scan_prunes_columns_and_months(spark, small):
    from pyspark.sql import functions as F

    final = registered.market(spark, small).final
    df = final.filter(F.col("transaction_year_month") == "2016-07").groupBy().sum("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:decimal(12,2)>" in plan
    assert re.search(r"PartitionFilters: \[.*2016-07", plan)


@pytest.mark.parametrize(
    ("name", "pushed", "pruned"),
    [
        ("day_app_leaders", "EqualTo(transaction_dt,2016-07-04)", "= 2016-07"),
        ("week_account_activity", "GreaterThanOrEqual(transaction_dt,2016-09-12)", ">= 2016-09"),
    ],
)
def test_day_and_week_filters_reach_the_scan(spark, small, name, pushed, pruned):
    df = registered.queries()[name](spark, small)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in plan
    assert re.search(r"PartitionFilters: \[.*" + re.escape(pruned), plan)


def test_large_sides_are_not_forced_to_broadcast(spark, small):
    """With automatic broadcasts off, the fact joins fall back to shuffles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("transaction_fact", "priced_transactions", "monthly_purchase_matrix"):
            df = registered.queries()[name](spark, small)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan, name
            assert "SortMergeJoin" in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
