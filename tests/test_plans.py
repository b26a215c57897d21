from decimal import Decimal

import pytest
from helpers import day, make_roles, one, rows
from pyspark.sql import functions as F
from shelfscope import Market, Rules
from shelfscope.plans import accounts, facts, leaders, pricing, quality, subscriptions, trends

APPS = [
    ("A", " app-a ", 1, 3),
    ("B", "app: b", 2, 1),
    ("C", "app c", None, 2),
]
INAPPS = [
    ("A", "c1", "consumable"),
    ("A", "c2", "subscription"),
    ("X", "c9", "consumable"),
    ("C", "c5", "subscription"),
]


def market(spark, transaction, account=(), **rules):
    roles = make_roles(spark, transaction, account, APPS, INAPPS)
    return Market(spark, roles, Rules(**rules))


def test_app_dimension_keeps_both_sides(spark):
    dim = market(spark, []).app_dimension
    got = rows(dim, "parent_app_content_id", "app_name", "category_name", "app_device_name",
               "content_id", "inapp_content_type", "content_id_modified")
    assert got == sorted(
        [
            ("A", "Appa", "Entertainment", "Both", "c1", "consumable", "c1"),
            ("A", "Appa", "Entertainment", "Both", "c2", "subscription", "c2"),
            ("B", "App B", "Games", "Phone", None, None, "B"),
            ("C", "App C", None, "Tablet", "c5", "subscription", "c5"),
            ("X", None, None, None, "c9", "consumable", "c9"),
        ],
        key=str,
    )


def test_purchases_resolve_by_content_then_by_app(spark):
    sold = [("2016-07-01", c, "u", 1, 1) for c in ("c1", "A", "B", "Z", "X")]
    got = rows(market(spark, sold).resolved, "transaction_content_id", "app_name",
               "parent_app_content_id", "content_id", "inapp_content_type",
               "transaction_device_name")
    assert got == sorted(
        [
            ("c1", "Appa", "A", "c1", "consumable", "Phone"),
            ("A", "Appa", "A", None, None, "Phone"),
            ("B", "App B", "B", None, None, "Phone"),
            ("Z", None, None, None, None, "Phone"),
            ("X", None, "X", None, None, "Phone"),
        ],
        key=str,
    )


def test_exact_copies_are_dropped(spark):
    sold = [("2016-07-01", "c1", "u", 1, 1)] * 2 + [("2016-07-01", "c1", "u", 2, 1)]
    m = market(spark, sold)
    assert m.resolved.count() == 2
    report = {r.table_name: r for r in quality.duplicate_report(m.roles).collect()}
    assert (report["transaction"].duplicate_ct, report["transaction"].duplicate_rate) == (1, 33.33)
    assert report["app"].is_unique


ACCOUNTS = [
    ("u", "2015-01-01", "PMOF"),
    ("v", "2016-08-01", "Free only"),
    ("idle", "2010-01-01", None),
]


def test_account_without_purchases_is_dormant(spark):
    sold = [("2016-07-01", "c1", "u", 3, 1), ("2016-07-02", "c1", "v", 0, 1)]
    summary = market(spark, sold, ACCOUNTS).account_summary
    got = rows(summary, "acct_id", "total_revenue", "total_txn", "paid_acct_flag", "no_txn_flag",
               "acct_txn_group", "entertainment_revenue", "avg_spend_amount")
    assert got == [
        ("idle", 0.0, 0, "Dormant", "Dormant", "Dormant", 0.0, None),
        ("u", 3.0, 1, "Purchased Paid App", "Active", "Low", 3.0, 3.0),
        ("v", 0.0, 1, "Free Only", "Active", "Low", 0.0, 0.0),
    ]
    tenure = {r.acct_id: (r.acct_tenure_days, r.tenure_band) for r in summary.collect()}
    assert tenure["v"] == (-30, None)
    assert tenure["idle"][1] == "5 years+"


def test_activity_group_limit(spark):
    sold = [("2016-07-01", "c1", "u", n, 1) for n in range(3)] + [("2016-07-01", "c1", "v", 1, 1)]
    summary = market(spark, sold, ACCOUNTS, low_limit=2).account_summary
    assert rows(summary, "acct_id", "acct_txn_group") == [
        ("idle", "Dormant"), ("u", "High"), ("v", "Low")
    ]


def test_final_fact_leaves_out_outliers_and_keeps_unknown_accounts(spark):
    sold = [
        ("2016-07-01", "c1", "u", 200, 1),
        ("2016-07-01", "c1", "v", 0, 1),
        ("2016-07-04", "c1", "guest", 7, 2),
        ("2016-07-04", "c1", None, 7, 2),
    ]
    m = market(spark, sold, ACCOUNTS, max_revenue=100)
    assert rows(m.outliers) == [("u", True, False)]
    got = rows(m.final, "acct_id", "acct_txn_group", "paid_acct_flag", "tenure_band",
               "transaction_without_acct", "first_day_of_the_week")
    assert got == sorted(
        [
            ("v", "Low", 0, None, 1, day("2016-06-27")),
            ("guest", None, 1, None, 0, day("2016-07-04")),
            (None, None, 0, None, 0, day("2016-07-04")),
        ],
        key=str,
    )


def test_final_edges_match_a_pass_over_the_purchases(spark, small):
    import __spark_entry__ as registered

    final = registered.market(spark, small).final
    low, high = one(final.agg(F.min("acct_tenure_days"), F.max("acct_tenure_days")))
    unbanded = final.filter(F.col("acct_tenure_days").isNotNull() & F.col("tenure_band").isNull())
    assert {r[0] for r in rows(unbanded, "acct_tenure_days")} == {low}
    assert final.filter(F.col("acct_tenure_days") == high).first().tenure_band == "5 years+"


def test_missing_category_passes_the_exclusion_but_forms_no_group(spark):
    sold = [("2016-07-01", c, "u", 1, 1) for c in ("c1", "B", "c5")]
    m = market(spark, sold, ACCOUNTS, not_subscription=("Games",))
    assert rows(m.subscription, "category_name") == sorted([("Entertainment",), (None,)], key=str)
    daily = trends.performance_daily_category(m.final)
    assert rows(daily, "category_name") == [("Entertainment",), ("Games",)]


def test_previous_day_without_revenue_gives_no_rate(spark):
    sold = [("2016-07-01", "c1", "u", 0, 1), ("2016-07-04", "c1", "u", 6, 1)]
    daily = trends.daily_app_performance(market(spark, sold, ACCOUNTS).final)
    got = rows(daily, "transaction_dt", "yesterday_revenue_by_app", "app_revenue_change",
               "app_revenue_change_rate", "app_txn_change_rate")
    assert got[1] == (day("2016-07-04"), 0.0, 6.0, None, 0.0)


def test_week_ranks(spark):
    sold = [
        ("2016-07-04", "c1", "u", 30, 1),
        ("2016-07-05", "B", "u", 30, 1),
        ("2016-06-27", "B", "u", 10, 1),
    ]
    ranked = market(spark, sold, ACCOUNTS).app_week
    got = rows(leaders.week_leaders(ranked), "app_name", "app_weekly_sales_rank",
               "category_weekly_sales_rank", "category_weekly_sales_dense_rank")
    assert got == [("App B", 1, 1, 1), ("Appa", 1, 1, 1)]
    only = leaders.category_leaders(ranked, category="Games")
    assert rows(only, "app_name", "app_weekly_sales_rank_category") == [("App B", 1)]


def test_monthly_purchase_matrix(spark):
    sold = [
        ("2016-06-10", "c1", "u", 2, 1),
        ("2016-08-10", "c1", "u", 3, 1),
        ("2016-06-11", "c2", "u", 0, 1),
        ("2016-07-11", "c2", "v", 4, 1),
        ("2016-07-11", "A", "v", 4, 1),
    ]
    m = market(spark, sold, ACCOUNTS)
    got = rows(m.purchase_matrix, "acct_id", "content_id", "revenue_2016_06", "revenue_2016_08",
               "purchase_month_ct", "repeat_purchase", "first_txn_dt", "app_name")
    assert got == [
        ("u", "c1", 2.0, 3.0, 2, 1, day("2016-06-10"), "Appa"),
        ("v", "c2", 0.0, 0.0, 1, 0, day("2016-07-11"), "Appa"),
    ]
    by_type = subscriptions.repeat_purchase_by_type(m.content_repeats, m.app_dimension)
    assert rows(by_type, "inapp_content_type", "acct_content_ct", "repeat_purchase_acct_ct") == [
        ("consumable", 1, 1), ("subscription", 1, 0)
    ]


def test_regular_price_and_promotion(spark):
    sold = [(f"2016-07-0{d}", "c1", "u", 5, 1) for d in (1, 2, 3)]
    sold += [("2016-07-04", "c1", x, 4, 1) for x in ("u", "v", "idle", "w")]
    m = market(spark, sold, ACCOUNTS)
    assert rows(m.regular_price) == [("c1", Decimal("4.00"), Decimal("5.00"))]
    priced = pricing.priced_transactions(m.final, m.regular_price)
    assert priced.count() == m.final.count() == 7
    cheap = pricing.promotions(m.final, m.regular_price)
    assert {round(r.promotion_rate, 9) for r in cheap.collect()} == {0.2}
    assert cheap.count() == 4


def test_regular_price_ties_go_to_the_lower(spark):
    sold = [("2016-07-01", "c1", "u", 5, 1), ("2016-07-02", "c1", "u", 4, 1)]
    assert rows(market(spark, sold, ACCOUNTS).regular_price) == [
        ("c1", Decimal("4.00"), Decimal("4.00"))
    ]


def test_free_contents_have_no_promotion_rate(spark):
    m = market(spark, [("2016-07-01", "c1", "u", 0, 1)], ACCOUNTS)
    priced = pricing.priced_transactions(m.final, m.regular_price)
    assert rows(priced, "promotion_flag", "promotion_rate") == [(0, None)]


def test_week_account_activity_lists_every_account(spark):
    sold = [("2016-07-04", "c1", "u", 3, 1), ("2016-06-27", "c1", "v", 3, 1)]
    m = market(spark, sold, ACCOUNTS)
    week = accounts.week_account_activity(m.final, m.roles.account, "2016-07-04")
    assert rows(week, "acct_id", "total_revenue", "total_txn", "paid_acct_flag") == [
        ("idle", 0.0, 0, "Dormant"), ("u", 3.0, 1, "Purchased Paid App"), ("v", 0.0, 0, "Dormant")
    ]


def test_pivot_skips_a_week_and_keeps_missing(spark):
    sold = [("2016-08-22", "c1", "u", 3, 1), ("2016-07-04", "B", "u", 3, 1)]
    pivot = trends.week_category_pivot(
        market(spark, sold, ACCOUNTS).weekly_category, [day("2016-08-22")]
    )
    assert rows(pivot, "first_day_of_the_week", "games", "entertainment") == [
        (day("2016-07-04"), 1, None)
    ]


def test_steps_keep_their_row_counts(spark, small):
    import __spark_entry__ as registered

    m = registered.market(spark, small)
    report = quality.row_count_report(m.roles, m.resolved, m.account_summary)
    assert all(r.same_count for r in report.collect())
    dim = facts.content_lookup(m.app_dimension)
    assert dim.count() == dim.select("transaction_content_id").distinct().count()


def test_totals_agree_across_day_week_and_month(spark, small):
    import __spark_entry__ as registered

    final = registered.market(spark, small).final
    total = one(final.agg(F.sum("price")))[0]
    for table, column in (
        (trends.performance_daily(trends.daily_counts(final)), "daily_sales"),
        (trends.performance_week(final), "weekly_sales"),
        (trends.performance_month(final), "monthly_sales"),
    ):
        assert one(table.agg(F.round(F.sum(column), 2)))[0] == pytest.approx(float(total))
    months = trends.performance_month(final)
    assert rows(months, "transaction_year_month", "transaction_ct") == rows(
        trends.txn_by(final, "transaction_year_month")
    )


def test_every_account_appears_once(spark, small):
    import __spark_entry__ as registered

    m = registered.market(spark, small)
    summary = m.account_summary
    assert summary.count() == summary.select("acct_id").distinct().count()
    assert summary.count() == m.roles.account.count()


def test_lazy_tables_give_the_same_reports(spark, small):
    import __spark_entry__ as registered
    from shelfscope import roles_from_star

    kept = registered.market(spark, small)
    lazy = Market(spark, roles_from_star(spark, small), registered.RULES, keep=False)
    assert rows(trends.performance_week(lazy.final)) == rows(trends.performance_week(kept.final))
    assert rows(lazy.outliers) == rows(kept.outliers)


def test_a_fifth_month_and_a_sixth_category_are_not_lost(spark):
    from shelfscope.sources.files import Roles

    sold = [(f"2016-{n:02}-10", "c1", "u", 2, 1) for n in (6, 7, 8, 9, 10)]
    sold += [("2016-10-11", "X", "u", 7, 1)]
    base = market(spark, sold, ACCOUNTS).roles
    tables = base.tables()
    more = spark.createDataFrame([(9, "Health & Fitness")], base.category.schema)
    app = spark.createDataFrame([("X", "exercise", 9, 1)], base.app.schema)
    tables |= {"category": base.category.union(more), "app": base.app.union(app)}
    m = Market(spark, Roles(**tables))
    (pair,) = rows(m.purchase_matrix.where("content_id = 'c1'"), "purchase_month_ct", "revenue_2016_10")
    assert pair == (5, 2.0)
    summary = m.account_summary.where("acct_id = 'u'")
    assert one(summary, "health_fitness_revenue", "total_revenue") == (7.0, 17.0)
    pivot = trends.week_category_pivot(m.weekly_category, categories=m.categories)
    assert one(pivot.agg(F.sum("health_fitness"))) == (1,)
    m.close()


def test_histograms_count_every_account(spark, small):
    import __spark_entry__ as registered
    from shelfscope.reports import reports

    m, known = registered.market(spark, small), reports()
    everyone = m.account_summary.count()
    buyers = {k: m.account_summary.where(f"{k} <> 0").count() for k in ("total_revenue", "total_txn")}
    for name, column in (("spend", "total_revenue"), ("txn", "total_txn")):
        assert one(known[f"{name}_histogram"](m).agg(F.sum("row_ct"))) == (everyone,)
        kinds = ("low", "within", "buyers" if name == "spend" else "active")
        for kind in kinds:
            got = known[f"{name}_histogram_{kind}"](m).agg(F.sum("row_ct"))
            assert one(got) == (buyers[column],), kind


def test_reports_from_rollups_do_not_scan_the_fact(spark, small):
    import __spark_entry__ as registered
    from shelfscope.reports import reports

    m, known = registered.market(spark, small), reports()
    for name in (
        "performance_daily", "performance_weekday", "performance_week_category", "latest_category_weeks",
        "week_snapshot_category", "week_snapshot_weekday", "week_category_pivot",
    ):
        plan = known[name](m)._jdf.queryExecution().executedPlan().toString()
        assert "acct_id" not in plan, name
    for name in ("performance_weekday_overall", "day_movers_txn"):
        assert "Expand" not in known[name](m)._jdf.queryExecution().executedPlan().toString()
    plan = known["subscription_summary"](m)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]
