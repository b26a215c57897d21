"""Aggregates by day and week that grow day by day, and the reports that read them alone.

Sums add up over days; distinct accounts and apps do not. They are kept as bitmaps over dense numbers
(exact) and as sketches (approximate and much smaller), and both merge over any days. Weeks, weekdays
and months are merges of days, so no report here scans the purchases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.dates import week_start, weekday_name, weekday_number, year_month
from shelfscope.functions.numbers import rows
from shelfscope.operators import sketches
from shelfscope.operators.bitmaps import member_bits, member_count
from shelfscope.operators.joins import without_ids
from shelfscope.operators.ranges import before_ranges, dense_numbers, in_ranges
from shelfscope.plans import trends
from shelfscope.sources.kept import checkpointed, exists

DAY, WEEK, CATEGORY = "transaction_dt", "first_day_of_the_week", "category_name"
ACCOUNT, APP = "acct_id", "parent_app_content_id"

# Columns of the stored tables; the last is the folder.
SCHEMAS = {
    "days": f"{CATEGORY} string, sales decimal(22,2), free_transaction_ct long, transaction_ct long, "
    f"acct_sketch binary, app_sketch binary, price_sketch binary, {DAY} date",
    "members": f"{CATEGORY} string, bucket long, bits binary, member string, {DAY} date",
    "weeks": f"{CATEGORY} string, sales decimal(32,2), active_days long, weekly_transaction_ct long, "
    f"active_acct_ct long, whole boolean, {WEEK} date",
    "loads": f"row_ct long, {DAY} date",
    f"numbers/{ACCOUNT}": f"{ACCOUNT} string, number long",
    f"numbers/{APP}": f"{APP} string, number long",
}

ACTIVE = "active_acct_ct"

KINDS = ("day", "week", "weekday", "month")


def period(kind: str) -> Column:
    """Name of a day's period of a kind."""
    day = F.col(DAY)
    names = {
        "day": lambda: day.cast("string"),
        "week": lambda: week_start(day).cast("string"),
        "weekday": lambda: weekday_name(day),
        "month": lambda: year_month(day),
    }
    return names[kind]().alias("period")


class Rollups:
    """Tables below a folder of their own, grown by ``load``.

    ``days`` has sums and sketches by day and category, ``members`` the accounts and apps of a day and
    category as bitmaps, ``weeks`` the measures of weeks by category and over all, ``loads`` the days that
    are in and their rows, and ``numbers`` the dense number of every account and app. Days and
    weeks are folders: a load writes those it has and leaves the others as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, keep=checkpointed):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._keep = keep

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self._folder}/{name}"
        return self._spark.read.schema(SCHEMAS[name]).parquet(path) if exists(self._spark, path) else None

    @property
    def days(self) -> DataFrame:
        return self._read("days")

    @property
    def members(self) -> DataFrame:
        return self._read("members")

    @property
    def weeks(self) -> DataFrame:
        return self._read("weeks")

    @property
    def loads(self) -> DataFrame:
        """(transaction_dt, row_ct) of every day that is in."""
        return self._read("loads")

    def load(self, purchases: DataFrame) -> None:
        """Take in all purchases of some days, in place of what these days had before.

        Purchases without a day are in no day report and stay out. Each day has to come whole: a
        part of a day replaces all of it. Days are marked as loaded when everything else is
        written, so after a load that broke off, loading the same days again puts things right.
        """
        dated = purchases.where(F.col(DAY).isNotNull())
        # Days are few, whatever the purchases.
        loaded = dated.groupBy(DAY).agg(rows().alias("row_ct"))
        found = loaded.collect()
        if not found:
            return
        self._number(dated, ACCOUNT)
        self._number(dated, APP)
        sums = dated.groupBy(DAY, CATEGORY).agg(
            F.sum("price").alias("sales"),
            F.sum("free_transaction_flag").alias("free_transaction_ct"),
            rows().alias("transaction_ct"),
            sketches.distinct_sketch(ACCOUNT).alias("acct_sketch"),
            sketches.distinct_sketch(APP).alias("app_sketch"),
            sketches.quantile_sketch(F.col("price")).alias("price_sketch"),
        )
        self._replace("days", sums, DAY)
        bits = [self._bits(dated, column) for column in (ACCOUNT, APP)]
        self._replace("members", bits[0].unionByName(bits[1]), DAY)
        touched = sorted({row[DAY].toordinal() - row[DAY].weekday() for row in found})
        self._replace("weeks", self._measured_weeks(touched), WEEK)
        self._replace("loads", self._spark.createDataFrame(found, loaded.schema), DAY)

    def _replace(self, name: str, df: DataFrame, by: str) -> None:
        """Write whole folders of ``by``, and none but those that ``df`` has."""
        together = df.hint("rebalance", F.col(by))
        writer = together.write.mode("overwrite").partitionBy(by)
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self._folder}/{name}")

    def _number(self, dated: DataFrame, column: str) -> None:
        """Give the values that have none yet the next numbers."""
        values = dated.where(F.col(column).isNotNull()).select(column).distinct()
        known = self._read(f"numbers/{column}")
        after = 0
        if known is not None:
            values = without_ids(values, known, column)
            after = known.agg(F.max("number")).first()[0] or 0
        numbered = dense_numbers(self._keep(values), column, after, self._keep)
        numbered.write.mode("append").parquet(f"{self._folder}/numbers/{column}")

    def _bits(self, dated: DataFrame, column: str) -> DataFrame:
        """Members by day and category. A member's rows of a day collapse before the join."""
        seen = dated.where(F.col(column).isNotNull()).select(DAY, CATEGORY, column).distinct()
        numbered = seen.join(self._read(f"numbers/{column}"), column)
        return member_bits(numbered, DAY, CATEGORY).withColumn("member", F.lit(column))

    def _measured_weeks(self, mondays: Sequence[int]) -> DataFrame:
        """Weeks (proleptic ordinals of their Mondays) by category, and over all categories.

        Filters on the folders: only the weeks' days are read.
        """
        first = F.lit("0001-01-01").cast("date")
        between = F.col(DAY).between(F.date_add(first, mondays[0] - 1), F.date_add(first, mondays[-1] + 5))
        wanted = between & F.datediff(week_start(F.col(DAY)), first).isin([m - 1 for m in mondays])
        days, members = (
            df.where(wanted).withColumn(WEEK, week_start(F.col(DAY))) for df in (self.days, self.members)
        )
        accounts = members.where(F.col("member") == ACCOUNT)

        def measured(keys: list[str], whole: bool) -> DataFrame:
            present = days.dropna(subset=keys)
            sums = present.groupBy(*keys).agg(
                F.sum("sales").alias("sales"),
                F.countDistinct(DAY).alias("active_days"),
                F.sum("transaction_ct").alias("weekly_transaction_ct"),
            )
            active = member_count(accounts.dropna(subset=keys), *keys, name=ACTIVE)
            joined = sums.join(active, keys, "left").na.fill(0, [ACTIVE])
            return joined.withColumn("whole", F.lit(whole))

        by_category = measured([WEEK, CATEGORY], False)
        over_all = measured([WEEK], True).withColumn(CATEGORY, F.lit(None).cast("string"))
        return by_category.unionByName(over_all)

    def counted(self, *keys: str, days: Column | None = None, **members: str) -> DataFrame:
        """Sums and distinct members of groups of days: what the reports share.

        ``keys`` are columns of ``days`` or of ``calendar``; groups with a missing key are left out. ``members``
        names the counts and their columns.
        """
        chosen = F.lit(True) if days is None else days
        present = calendar(self.days).where(chosen).dropna(subset=list(keys))
        sums = present.groupBy(*keys).agg(
            F.sum("sales").alias("sales"),
            F.sum("free_transaction_ct").alias("free_transaction_ct"),
            F.sum("transaction_ct").alias("transaction_ct"),
            F.countDistinct(DAY).alias("active_days"),
        )
        seen = calendar(self.members).where(chosen).dropna(subset=list(keys))
        found = F.col("member")
        each = member_count(seen.where(found.isin([*members.values()])), *keys, "member", name="ct")
        counts = [F.coalesce(F.sum(F.when(found == c, F.col("ct"))), F.lit(0)).alias(n) for n, c in members.items()]
        return sums.join(each.groupBy(*keys).agg(*counts), list(keys), "left").na.fill(0, [*members])


def calendar(df: DataFrame) -> DataFrame:
    """Calendar columns that follow from the day."""
    day = F.col(DAY)
    return df.withColumns(
        {
            WEEK: week_start(day),
            "transaction_weekday": weekday_number(day),
            "transaction_weekday_nm": weekday_name(day),
            "transaction_year_month": year_month(day),
        }
    )


def daily(rollups: Rollups) -> DataFrame:
    """As ``trends.daily_counts`` of the purchases."""
    return rollups.counted(DAY, active_acct_ct=ACCOUNT, active_unique_app=APP).drop("active_days")


def daily_category(rollups: Rollups) -> DataFrame:
    return rollups.counted(DAY, CATEGORY, active_acct_ct=ACCOUNT).drop("active_days")


def _weeks(rollups: Rollups, whole: bool) -> DataFrame:
    """Measures of weeks as ``trends.weekly_changes`` takes them."""
    found = rollups.weeks.where(F.col("whole") == whole).drop("whole")
    found = found.withColumn("sales", F.coalesce("sales", F.lit(0)).cast("double"))
    return found.withColumnRenamed("sales", "weekly_sales")


def performance_week(rollups: Rollups) -> DataFrame:
    return trends.weekly_changes(_weeks(rollups, True).drop(CATEGORY), [])


def performance_week_category(rollups: Rollups) -> DataFrame:
    return trends.weekly_changes(_weeks(rollups, False), [CATEGORY])


def performance_weekday_overall(rollups: Rollups) -> DataFrame:
    """Weekdays over the whole period."""
    weekday = ["transaction_weekday", "transaction_weekday_nm"]
    counted = rollups.counted(*weekday, purchased_acct_ct=ACCOUNT, purchased_unique_app=APP)
    totals = counted.withColumn("total_sales", F.coalesce("sales", F.lit(0)).cast("double"))
    totals = totals.withColumnRenamed("transaction_ct", "total_transaction_ct").drop("sales", "free_transaction_ct")
    return trends.daily_means(totals, "total_transaction_ct", "total_sales").orderBy("transaction_weekday")


def performance_month(rollups: Rollups, exclude_days: Sequence = ()) -> DataFrame:
    """Months without some days: their members are merged anew from the days that stay."""
    kept = F.lit(True)
    for day in exclude_days:
        kept &= ~F.col(DAY).eqNullSafe(F.lit(day).cast("date"))
    counted = rollups.counted("transaction_year_month", days=kept, active_acct_ct=ACCOUNT, purchased_unique_app=APP)
    months = counted.withColumn("monthly_sales", F.coalesce("sales", F.lit(0)).cast("double"))
    months = months.drop("sales", "free_transaction_ct")
    return trends.daily_means(months, "transaction_ct", "monthly_sales")


def distinct_by_period(rollups: Rollups, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Approximate accounts and apps of periods, next to the exact ones: estimates and their bounds.

    Only sketches are merged for the estimates, a few kilobytes for each day and category whatever the
    number of accounts.
    """
    keys = ["period_kind", "period"]

    def by_period(df: DataFrame) -> DataFrame:
        """Each row once for every kind of period."""
        named = [F.struct(F.lit(kind).alias(keys[0]), period(kind)) for kind in kinds]
        return df.select("*", F.inline(F.array(*named)))

    columns = {"acct": ACCOUNT, "app": APP}
    merged = by_period(rollups.days).groupBy(*keys).agg(
        *[sketches.distinct_estimate(sketches.merged_distinct(f"{c}_sketch")).alias(f"{c}_estimate") for c in columns]
    )
    each = member_count(by_period(rollups.members), *keys, "member", name="ct")
    counts = [F.sum(F.when(F.col("member") == column, F.col("ct"))).alias(f"{c}_ct") for c, column in columns.items()]
    found = merged.join(each.groupBy(*keys).agg(*counts), keys, "left").na.fill(0, [f"{c}_ct" for c in columns])
    for c in columns:
        low, high = sketches.distinct_bounds(F.col(f"{c}_estimate"))
        found = found.withColumns({f"{c}_low": low, f"{c}_high": high})
    return found


def distinct_check(rollups: Rollups) -> DataFrame:
    """Exact counts by period, and whether the estimates' bounds hold them."""
    found = distinct_by_period(rollups)
    held = [F.col(f"{c}_ct").between(F.col(f"{c}_low"), F.col(f"{c}_high")).alias(f"{c}_within") for c in ("acct", "app")]
    return found.select("period_kind", "period", "acct_ct", "app_ct", *held)


SHARES = (0.25, 0.5, 0.75)


def price_quantiles(rollups: Rollups, kind: str = "month", shares: Sequence[float] = SHARES) -> DataFrame:
    """(period, share, estimate): quartiles of prices merged from the days' sketches."""
    merged = rollups.days.groupBy(period(kind)).agg(
        sketches.merged_quantiles("price_sketch").alias("sketch")
    )
    found = [
        F.struct(F.lit(share).alias("share"), sketches.quantile("sketch", share).alias("estimate")) for share in shares
    ]
    return merged.select("period", F.inline(F.array(*found)))


def price_positions(final: DataFrame, kind: str = "month", keep=checkpointed) -> DataFrame:
    """(period, value, below, upto, n): how many prices of a period lie below each value, and up to it.

    Equal prices collapse to a count; the distinct ones are ordered in ranges.
    """
    priced = final.where(F.col("price").isNotNull() & F.col(DAY).isNotNull())
    ties = priced.groupBy(period(kind), F.col("price").cast("double").alias("value")).agg(rows().alias("ct"))
    placed = in_ranges(keep(ties), ["period", "value"], keep)
    heads = before_ranges(placed, ["period"], F.col("ct"), "earlier")
    upto = F.col("earlier") + F.expr("sum(ct) OVER (PARTITION BY period, part ORDER BY value)")
    total = placed.groupBy("period").agg(F.sum("ct").alias("n"))
    found = placed.join(heads, ["period", "part"]).withColumn("upto", upto).join(total, "period")
    return found.select("period", "value", (F.col("upto") - F.col("ct")).alias("below"), "upto", "n")


def quantile_check(rollups: Rollups, final: DataFrame, kind: str = "month", keep=checkpointed) -> DataFrame:
    """Exact quartiles of prices by period, and whether the sketches' estimates are within their rank bound.

    The exact quartile is the least price that a share of all prices does not exceed.
    """
    at = keep(price_positions(final, kind, keep))
    estimates = price_quantiles(rollups, kind)
    exact = at.join(estimates, "period").where(F.col("upto") >= F.col("share") * F.col("n"))
    exact = exact.groupBy("period", "share", "estimate", "n").agg(F.min("value").alias("exact"))
    # The estimate is one of the prices: its ranks are those of its row.
    ranked = exact.join(at.select("period", F.col("value").alias("estimate"), "below", "upto"), ["period", "estimate"], "left")
    room = F.lit(sketches.RANK_ERROR) * F.col("n")
    wanted = F.col("share") * F.col("n")
    within = (F.col("below") <= wanted + room) & (F.col("upto") >= wanted - room)
    return ranked.select("period", "share", "exact", F.coalesce(within, F.lit(False)).alias("within"))
