"""The six roles as views of a retail star schema (lineitem, orders, customer, part, ...).

Every role covers its whole base tables: line items are purchases, customers accounts,
suppliers apps, parts in-app content, regions categories. The order dates are laid over 110
days from 2016-06-01. Some purchases name the app itself, some a withdrawn id, some a guest
account, and some are delivered twice, so that every branch of the fact has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.schemas import CATEGORY_COLUMNS, MONEY
from shelfscope.sources.files import Roles

# Fixed values of the mapping.
FIRST_ORDER = "1995-01-01"
FIRST_DAY = "2016-06-01"
ORDER_DAYS_PER_DAY = 22
DEVICES = [(1, "Phone"), (2, "Tablet"), (3, "Both")]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _days(text: str):
    return F.lit(text).cast("date")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    sold = _read(spark, folder, "lineitem").join(
        _read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    order_day = F.datediff(F.col("o_orderdate").cast("date"), _days(FIRST_ORDER))
    day = F.date_add(_days(FIRST_DAY), F.floor(order_day / ORDER_DAYS_PER_DAY).cast("int"))
    is_app = (F.col("l_returnflag") == "R") & (F.col("l_tax") <= 0.02)
    is_withdrawn = (F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.07)
    content = (
        F.when(is_app, F.concat(F.lit("app-"), "l_suppkey"))
        .when(is_withdrawn, F.concat(F.lit("gone-"), "l_partkey"))
        .otherwise(F.concat(F.lit("item-"), "l_partkey"))
    )
    # Every third customer buys through the next one, which leaves accounts without purchases.
    buyer = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(
        F.col("o_custkey")
    )
    is_guest = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    account = F.concat(F.when(is_guest, "guest-").otherwise("acct-"), buyer)
    # A price per content, lower by a fifth in a promotion; some accounts only take free items.
    step = (F.when(is_app, F.col("l_suppkey")).otherwise(F.col("l_partkey")) * 13) % 24
    full = step * 100 + 99
    cents = (
        F.when((buyer * 31) % 10 < 3, 0)
        .when((step < 8) | (F.col("l_discount") == 0), 0)
        .when(F.col("l_discount") >= 0.09, F.floor(full * 4 / 5))
        .otherwise(full)
    )
    twice = (F.col("l_tax") == 0.05) & (F.col("l_discount") == 0.05)
    delivered = F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return sold.select(
        day.alias("create_dt"),
        content.alias("content_id"),
        account.alias("acct_id"),
        (cents.cast("decimal(8,0)") / F.lit(100)).cast(MONEY).alias("price"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("device_id"),
        F.explode(delivered).alias("delivery"),
    ).drop("delivery")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    free = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    age = ((F.col("c_custkey") * 37) % 2500).cast("int")
    return _read(spark, folder, "customer").select(
        F.concat(F.lit("acct-"), "c_custkey").alias("acct_id"),
        F.date_sub(_days("2016-10-15"), age).alias("create_dt"),
        F.when(F.col("c_acctbal") < -900, F.lit(None))
        .when(free, "Free only")
        .otherwise("PMOF")
        .alias("payment_type"),
    )


def apps(spark: SparkSession, folder: str) -> DataFrame:
    nation = _read(spark, folder, "nation")
    name = F.concat(
        F.lit("  studio "),
        F.col("s_nationkey").cast("string"),
        F.lit("b: pro-kit "),
        (F.col("s_suppkey") % 7).cast("string"),
        F.lit("x (hd) "),
    )
    return (
        _read(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("app-"), "s_suppkey").alias("content_id"),
            name.alias("app_name"),
            F.col("n_regionkey").cast("int").alias("category_id"),
            (F.col("s_suppkey") % 3 + 1).cast("int").alias("device_id"),
        )
    )


def inapps(spark: SparkSession, folder: str) -> DataFrame:
    # Parts number twenty to a supplier; grouped by 25 they leave every fifth app without any.
    parent = F.concat(F.lit("app-"), F.floor(F.col("p_partkey") / 25))
    pulled = (F.col("p_brand") == "Brand#13") & (F.col("p_size") > 40)
    return _read(spark, folder, "part").select(
        F.when(pulled, F.concat(F.lit("pulled-"), "p_size")).otherwise(parent).alias(
            "parent_app_content_id"
        ),
        F.concat(F.lit("item-"), "p_partkey").alias("content_id"),
        F.when(F.col("p_size") % 2 == 0, "subscription").otherwise("consumable").alias("type"),
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    # Compared rather than used as an index, so that the key may be of any whole number type.
    key = F.col("r_regionkey")
    names = [F.when(key == place, name) for place, name in enumerate(CATEGORY_COLUMNS)]
    return _read(spark, folder, "region").select(
        key.cast("int").alias("category_id"), F.coalesce(*names).alias("category_name")
    )


def devices(spark: SparkSession) -> DataFrame:
    # An inline relation, so that its size is known to the join planning.
    values = ", ".join(f"({key}, '{name}')" for key, name in DEVICES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS device(device_id, device_name)")


def roles_from_star(spark: SparkSession, folder: str) -> Roles:
    return Roles(
        transaction=transactions(spark, folder),
        account=accounts(spark, folder),
        app=apps(spark, folder),
        inapp=inapps(spark, folder),
        category=categories(spark, folder),
        device=devices(spark),
    )
