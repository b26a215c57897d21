"""One account and one content hold a third of all purchases each."""

import __spark_entry__ as registered
import pytest
from oracle_check import connect, differences
from pyspark.sql import functions as F
from shelfscope import Market, roles_from_star
from shelfscope.plans import facts, pricing, subscriptions

# Queries whose joins, groups or ranks meet the hot keys.
NAMES = [
    "transaction_fact",
    "final_fact",
    "account_summary",
    "account_statistics",
    "final_statistics",
    "performance_daily",
    "performance_week_category",
    "app_week",
    "category_leaders",
    "monthly_purchase_matrix",
    "repeat_purchase_summary",
    "repeat_purchase_by_type",
    "repeat_by_content_utilities",
    "repeat_test_entertainment",
    "repeat_test_utilities",
    "repeat_test_photos_videos",
    "priced_transactions",
    "tenure_price_performance",
    "orphan_accounts",
]


@pytest.fixture(scope="module")
def hot(spark, small, tmp_path_factory):
    """The small tables with a hot account and a hot content, in a folder of their own."""
    folder = tmp_path_factory.mktemp("hot")
    names = [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem"
    ]
    for name in names:
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "orders":
            hot_key = F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(F.col("o_custkey"))
            df = df.withColumn("o_custkey", hot_key.cast("long"))
        if name == "lineitem":
            hot_key = F.when(F.col("l_shipdate") < "1999-01-01", 17).otherwise(F.col("l_partkey"))
            df = df.withColumn("l_partkey", hot_key.cast("long"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def oracle(hot):
    return connect(hot)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_change_no_result(spark, hot, oracle, name):
    df = registered.queries()[name](spark, hot)
    assert differences(df, oracle, registered.oracle_sql()[name]) == []


def test_the_data_is_hot(spark, hot):
    roles = roles_from_star(spark, hot)
    for key in ("acct_id", "content_id"):
        top = roles.transaction.groupBy(key).count().agg(F.max("count")).first()[0]
        assert top > 0.2 * roles.transaction.count(), key


def test_hot_partitions_are_split(spark, hot, tmp_path):
    """Where the other side is too big to broadcast, Spark splits the hot key's partition."""
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.files.maxPartitionBytes": "16KB",
    }
    market = Market(spark, roles_from_star(spark, hot), folder=str(tmp_path))
    # A partition is split between the tasks that wrote it, so there must be several.
    resolved, final = market.resolved.repartition(16), market.final.repartition(16)
    traits, prices, dim = market.account_traits, market.regular_price, market.app_dimension
    before = {key: spark.conf.get(key) for key in lowered}
    for key, value in lowered.items():
        spark.conf.set(key, value)
    try:
        joins = {
            "account": facts.final_fact(facts.ordinary_purchases(resolved, traits), traits),
            "price": pricing.priced_transactions(final, prices),
            "content": facts.lookup(
                resolved.select("transaction_content_id", "acct_id", "price"),
                facts.content_lookup(dim),
                "transaction_content_id",
            ),
        }
        for name, df in joins.items():
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan, name
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_repeats_are_added_up_before_any_join(spark, hot, tmp_path):
    """No join carries account-content pairs: the contents' table is read, not the purchases."""
    market = Market(spark, roles_from_star(spark, hot), registered.RULES, folder=str(tmp_path))
    repeats, dim = market.content_repeats, market.app_dimension
    assert repeats.count() == repeats.select("content_id").distinct().count()
    for df in (
        subscriptions.repeat_purchase_by_type(repeats, dim),
        subscriptions.repeat_by_content(repeats, dim, "Utilities"),
    ):
        assert "acct_id" not in df._jdf.queryExecution().executedPlan().toString()
