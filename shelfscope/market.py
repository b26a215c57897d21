"""A market: six input tables, and the derived tables its reports read."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.text import column_name
from shelfscope.plans import accounts, facts, leaders, pricing, rollups, subscriptions, trends
from shelfscope.rules import Rules
from shelfscope.sources.day_tables import DayTable
from shelfscope.sources.files import Roles
from shelfscope.sources.kept import (
    KeptTables,
    Profile,
    buckets_for,
    checkpointed,
    clustered,
    observed,
)

MONTH = "transaction_year_month"


class Market:
    """Shared derived tables, each built on first use and kept for the application.

    ``keep=False`` leaves every table lazy, so that a report is one plan from the inputs.
    """

    def __init__(
        self,
        spark: SparkSession,
        roles: Roles,
        rules: Rules | None = None,
        keep: bool = True,
        folder: str | None = None,
    ):
        self.roles = roles
        self.rules = rules or Rules()
        self._spark = spark
        self._kept = KeptTables(spark, folder) if keep else None
        self._trips: KeptTables | None = None
        self._rollups: rollups.Rollups | None = None
        self._scanned: dict[str, Profile] = {}
        self._categories: dict[str, str] | None = None
        self._months: tuple[str, ...] | None = None

    def close(self) -> None:
        """Delete the kept tables and the files of round trips; the market is not used again."""
        for tables in (self._kept, self._trips):
            if tables:
                tables.close()
        self._rollups, self._scanned = None, {}

    @property
    def folder(self) -> str:
        """Where this market writes: ``close`` deletes it."""
        if not self._kept and not self._trips:
            self._trips = KeptTables(self._spark)
        return (self._kept or self._trips).folder

    @property
    def keeps(self) -> bool:
        """Whether derived tables are stored, rollups among them."""
        return self._kept is not None

    def step(self, df: DataFrame) -> DataFrame:
        """A stored copy of a step: in this market's folder, or a checkpoint."""
        return self._kept.step(df) if self._kept else checkpointed(df)

    def profile(self, name: str) -> Profile:
        """Rows and present values of a derived table: counted when it was written, or by one scan."""
        table = getattr(self, name)
        if self._kept and name in self._kept.profiles:
            return self._kept.profiles[name]
        if name not in self._scanned:
            counted, profile = observed(table)
            counted.write.format("noop").mode("overwrite").save()
            self._scanned[name] = profile()
        return self._scanned[name]

    @property
    def categories(self) -> dict[str, str]:
        """Names and columns of the categories: those of the rules, or all of the category table.

        They become columns, so their number is that of a table's columns.
        """
        if self._categories is None:
            names = self.rules.categories
            if names is None:
                found = self.roles.category.select("category_name").distinct().dropna()
                names = sorted(row[0] for row in found.collect())
            self._categories = {name: column_name(name) for name in names}
        return self._categories

    @property
    def months(self) -> tuple[str, ...]:
        """The rules' months, or all with an ordinary purchase (folders of the final fact)."""
        if self._months is None:
            months = self.rules.months
            if months is None:
                months = sorted(row[0] for row in self.final.select(MONTH).distinct().dropna().collect())
            self._months = tuple(months)
        return self._months

    def _get(self, name: str, build, **layout) -> DataFrame:
        return self._kept.get(name, build, **layout) if self._kept else build()

    @property
    def app_dimension(self) -> DataFrame:
        r = self.roles
        return self._get(
            "app_dimension", lambda: facts.app_dimension(r.app, r.inapp, r.category, r.device)
        )

    @property
    def resolved(self) -> DataFrame:
        """Distinct purchases with app, content and device."""
        return self._get(
            "resolved",
            lambda: facts.resolved_transactions(
                facts.distinct_transactions(self.roles.transaction),
                self.app_dimension,
                self.roles.device,
            ),
        )

    def distinct_by_day(self, *loads: DataFrame) -> DataFrame:
        """Distinct purchases, taken in by parts that may come late and repeat what is there."""
        schema = facts.distinct_transactions(self.roles.transaction).schema
        grown = DayTable(self._spark, f"{self.folder}/distinct-{uuid.uuid4().hex}", schema, "transaction_dt", self.step)
        for load in loads:
            grown.load(facts.named_transactions(load))
        return grown.table

    @property
    def transaction_fact(self) -> DataFrame:
        return facts.transaction_fact(self.resolved, self.roles.account)

    @property
    def activity(self) -> DataFrame:
        return self._get(
            "activity", lambda: accounts.account_activity(self.resolved, self.categories)
        )

    @property
    def account_summary(self) -> DataFrame:
        return self._get(
            "account_summary",
            lambda: accounts.account_summary(
                self.roles.account, self.activity, self.rules.low_limit, self.categories
            ),
        )

    @property
    def outliers(self) -> DataFrame:
        return self._get(
            "outliers",
            lambda: accounts.outlier_accounts(
                self.account_summary, self.rules.max_revenue, self.rules.max_transactions
            ),
        )

    @property
    def account_traits(self) -> DataFrame:
        """Stored, so that the join of the purchases has a plain scan on its small side: only
        then may Spark split the partition of an account with very many purchases."""
        return self._get(
            "account_traits",
            lambda: accounts.account_traits(self.activity, self.account_summary, self.outliers),
        )

    @property
    def final(self) -> DataFrame:
        """The fact nearly all reports read: months are folders, days lie together in files.

        Rows are brought together before the attributes that follow from a row are added.
        """

        def build() -> DataFrame:
            purchases = facts.ordinary_purchases(self.resolved, self.account_traits)
            if self._kept:
                purchases = clustered(purchases, "transaction_dt", within=[MONTH])
            return facts.final_fact(purchases, self.account_traits)

        return self._get("final", build, partition_by=[MONTH])

    def _bucketed(
        self, by: str, sides: Mapping[str, str], largest: DataFrame
    ) -> tuple[DataFrame, DataFrame] | None:
        """Two derived tables, as copies in buckets of ``by``: none if a key has too many rows.

        ``sides`` maps the copies to the tables, the large one first; ``largest`` has the rows of the most
        frequent key.
        """
        if not self._kept:
            return None
        table = next(iter(sides.values()))
        seen = self.profile(table)
        missing = seen.row_ct - seen.value_ct[by]
        buckets = buckets_for(seen.row_ct, max(largest.first()[0] or 0, missing))
        if not buckets:
            return None
        first, second = (
            self._get(name, lambda source=source: getattr(self, source), bucket_by=[by], buckets=buckets)
            for name, source in sides.items()
        )
        return first, second

    @property
    def final_by_account(self) -> DataFrame:
        """The final fact from tables in buckets of accounts: its join moves no purchases.

        If one account has too many of them, it is the fact as it is.
        """
        largest = self.activity.dropna(subset=["acct_id"]).agg(F.max("total_txn"))
        sides = {"resolved_by_account": "resolved", "traits_by_account": "account_traits"}
        found = self._bucketed("acct_id", sides, largest)
        if not found:
            return self.final
        purchases, traits = found
        return facts.final_fact(facts.ordinary_purchases(purchases, traits), traits)

    @property
    def priced_by_content(self) -> DataFrame:
        """Purchases with their regular prices, from tables in buckets of contents, likewise."""
        counted = self.final.dropna(subset=["content_id"]).groupBy("content_id").count()
        sides = {"final_by_content": "final", "prices_by_content": "regular_price"}
        found = self._bucketed("content_id", sides, counted.agg(F.max("count")))
        return pricing.priced_transactions(*(found or (self.final, self.regular_price)))

    @property
    def rollups(self) -> rollups.Rollups:
        """Sums, sketches and bitmaps by day: the base of the reports by day, weekday, week and month."""
        if not self._kept:
            raise ValueError("a market that keeps no tables has no rollups")
        if self._rollups is None:
            grown = rollups.Rollups(self._spark, f"{self.folder}/rollups", self._kept.step)
            grown.load(self.final)
            self._rollups = grown
        return self._rollups

    @property
    def daily(self) -> DataFrame:
        """Measures by day: small, and the base of the weekday reports."""
        return self._get(
            "daily",
            lambda: rollups.daily(self.rollups) if self.keeps else trends.daily_counts(self.final),
        )

    @property
    def weekly_category(self) -> DataFrame:
        """Measures by week and category."""

        def build() -> DataFrame:
            if self.keeps:
                return rollups.performance_week_category(self.rollups)
            return trends.performance_week_category(self.final)

        return self._get("weekly_category", build)

    @property
    def week_activity(self) -> DataFrame:
        """Every account with what it bought in the rules' last week."""
        return self._get(
            "week_activity",
            lambda: accounts.week_account_activity(self.final, self.roles.account, self.rules.last_week),
        )

    @property
    def content_repeats(self) -> DataFrame:
        """Account-content pairs and repeats by content."""
        pairs = subscriptions.purchase_months(
            self.subscription, ["acct_id", "content_id"], self.months
        )
        return self._get("content_repeats", lambda: subscriptions.content_repeats(pairs))

    @property
    def app_week_counts(self) -> DataFrame:
        return self._get("app_week_counts", lambda: leaders.app_week_counts(self.final))

    @property
    def app_week(self) -> DataFrame:
        """Ranked apps by week."""
        return self._get("app_week", lambda: leaders.app_week(self.app_week_counts, self.step))

    @property
    def subscription(self) -> DataFrame:
        return subscriptions.subscription_transactions(self.final, self.rules.not_subscription)

    @property
    def purchase_matrix(self) -> DataFrame:
        return subscriptions.monthly_purchase_matrix(
            self.subscription, self.app_dimension, self.months
        )

    @property
    def regular_price(self) -> DataFrame:
        """Stored for the same reason as the account traits: a bestseller's rows can be split."""
        return self._get("regular_price", lambda: pricing.regular_price(self.final))
