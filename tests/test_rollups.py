"""Rollups that grow, sketches, bitmaps, distributed order, observed profiles, bucketed tables."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import __spark_entry__ as registered
import pytest
from helpers import rows
from pyspark.sql import functions as F
from shelfscope import Market, roles_from_star
from shelfscope.operators import bitmaps, checks, ordering, profile, ranges, sketches
from shelfscope.plans import rollups, trends
from shelfscope.reports import PROFILED, reports
from shelfscope.sources.day_tables import DayTable
from shelfscope.sources.kept import KeptTables, buckets_for, checkpointed, exists

KINDS = (
    "transaction_dt date, category_name string, acct_id string, parent_app_content_id string, "
    "price decimal(12,2), free_transaction_flag int"
)
START = dt.date(2016, 6, 27)


def purchases(days, per_day, accounts, seed=1):
    rng = random.Random(seed)
    found = []
    for day in days:
        for _ in range(per_day):
            price = rng.choice([None, 0, 99, 199, 499, 1999])
            found.append((
                START + dt.timedelta(day), rng.choice(["Games", "Utilities", None]),
                rng.choice([None, f"u{rng.randrange(accounts)}"]), rng.choice([None, f"app-{rng.randrange(30)}"]),
                None if price is None else Decimal(price) / 100, int(price == 0),
            ))
    return found


@pytest.fixture(scope="module")
def sold(spark):
    return spark.createDataFrame(purchases(range(16), 120, 200) + [(None, "Games", "u1", "app-1", Decimal(1), 0)], KINDS)


@pytest.fixture(scope="module")
def folder(spark):
    tables = KeptTables(spark)
    yield tables.folder
    tables.close()


def contents(grown):
    """All of a rollup's tables but the sketches; members by their numbers' meaning."""
    names = {}
    for column in (rollups.ACCOUNT, rollups.APP):
        found = grown._read(f"numbers/{column}").collect()
        assert sorted(r.number for r in found) == list(range(1, len(found) + 1))
        names[column] = {r.number: r[column] for r in found}
    members = set()
    for r in grown.members.collect():
        for place, byte in enumerate(r.bits):
            for bit in range(8):
                if byte >> bit & 1:
                    number = (r.bucket - 1) * 32768 + place * 8 + bit + 1
                    members.add((r.transaction_dt, r.category_name, r.member, names[r.member][number]))
    days = rows(grown.days.drop("acct_sketch", "app_sketch", "price_sketch").select(*sorted(grown.days.columns)[2:3],
                "transaction_dt", "category_name", "sales", "transaction_ct", "free_transaction_ct"))
    weeks = rows(grown.weeks.select(*sorted(grown.weeks.columns)))
    return days, members, weeks, rows(grown.loads, "transaction_dt", "row_ct")


def test_two_loads_equal_one(spark, sold, folder):
    late = F.col("transaction_dt") >= START + dt.timedelta(10)
    once = rollups.Rollups(spark, f"{folder}/once")
    once.load(sold)
    twice = rollups.Rollups(spark, f"{folder}/twice")
    twice.load(sold.where(~late))
    before = rows(twice.weeks.where(F.col("first_day_of_the_week") < START + dt.timedelta(7)))
    twice.load(sold.where(late))
    assert contents(once) == contents(twice)
    assert before == rows(twice.weeks.where(F.col("first_day_of_the_week") < START + dt.timedelta(7)))
    for kind in rollups.KINDS:
        assert rows(rollups.distinct_by_period(once, [kind])) == rows(rollups.distinct_by_period(twice, [kind]))


def test_a_day_loaded_again_is_replaced(spark, sold, folder):
    changed = START + dt.timedelta(3)
    grown = rollups.Rollups(spark, f"{folder}/again")
    grown.load(sold)
    new = spark.createDataFrame([(changed, "Games", "new", "app-1", Decimal("5.00"), 0)], KINDS)
    grown.load(new)
    once = rollups.Rollups(spark, f"{folder}/changed")
    once.load(sold.where(F.col("transaction_dt") != changed).unionByName(new))
    got, want = contents(grown), contents(once)
    assert got == want
    grown.load(sold.limit(0))
    assert contents(grown) == want


def test_reports_of_rollups_equal_those_of_purchases(spark, sold, folder):
    grown = rollups.Rollups(spark, f"{folder}/reports")
    grown.load(sold)
    fact = rollups.calendar(sold)
    spike = START + dt.timedelta(4)
    pairs = [
        (rollups.daily(grown), trends.daily_counts(fact)),
        (rollups.daily_category(grown), trends.daily_counts(fact, "category_name").drop("active_unique_app")),
        (rollups.performance_week(grown), trends.performance_week(fact)),
        (rollups.performance_week_category(grown), trends.performance_week_category(fact)),
        (rollups.performance_month(grown, [spike]), trends.performance_month(fact, [spike])),
        (
            rollups.performance_weekday_overall(grown),
            trends.performance_weekday_overall(fact.where("transaction_dt IS NOT NULL"), trends.daily_counts(fact)),
        ),
    ]
    for rolled, scanned in pairs:
        assert sorted(rolled.columns) == sorted(scanned.columns)
        assert rows(rolled, *sorted(rolled.columns)) == rows(scanned, *sorted(rolled.columns))


def test_period_reports_read_rollups_alone(spark, small):
    m, known = registered.market(spark, small), reports()
    final = m.final.inputFiles()[0].rsplit("/final/")[0]
    for name in (
        "performance_daily", "performance_daily_category", "performance_weekday_overall", "performance_week",
        "performance_week_category", "performance_month", "performance_month_without_spike", "performance_weekday",
        "approximate_distinct",
    ):
        files = known[name](m).inputFiles()
        assert files and not [f for f in files if f.startswith(f"{final}/final/")], name
    plan = rollups.performance_month(m.rollups)._jdf.queryExecution().executedPlan().toString()
    assert "sketch" not in plan


def test_estimates_are_within_their_bounds(spark, folder):
    """Of 60,000 accounts, beyond the sizes at which sketches are exact."""
    df = spark.range(200_000).select(
        F.date_add(F.lit(START), (F.col("id") % 14).cast("int")).alias("transaction_dt"),
        F.lit("Games").alias("category_name"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(60_000))).alias("acct_id"),
        F.concat(F.lit("app-"), F.col("id") % 40).alias("parent_app_content_id"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000)) / 100).cast("decimal(12,2)").alias("price"),
        F.lit(0).alias("free_transaction_flag"),
    )
    grown = rollups.Rollups(spark, f"{folder}/large")
    grown.load(df)
    found = rollups.distinct_by_period(grown).collect()
    exact = df.groupBy(rollups.period("month")).agg(F.countDistinct("acct_id")).collect()
    assert {(r.period, r.acct_ct) for r in found if r.period_kind == "month"} == {tuple(r) for r in exact}
    assert max(r.acct_ct for r in found) > 50_000
    assert any(r.acct_estimate != r.acct_ct for r in found)
    for r in found:
        assert r.acct_low <= r.acct_ct <= r.acct_high
        assert r.acct_high - r.acct_low < 0.14 * r.acct_ct + 2
    for kind in ("day", "week", "month"):
        assert all(r.within for r in rollups.quantile_check(grown, df, kind).collect())


def test_estimates_of_nothing_and_of_missing_values(spark, folder):
    grown = rollups.Rollups(spark, f"{folder}/missing")
    assert grown.days is None
    grown.load(spark.createDataFrame([(START, None, None, None, None, 0)], KINDS))
    (found,) = rollups.distinct_by_period(grown, ["week"]).collect()
    assert (found.acct_ct, found.acct_estimate, found.app_ct) == (0, 0, 0)
    (row,) = rollups.daily(grown).collect()
    assert (row.active_acct_ct, row.sales, row.transaction_ct) == (0, None, 1)


def test_bitmaps_hold_members_across_buckets(spark):
    numbers = [1, 2, 32768, 32769, 65536, 65537, 100_000]
    df = spark.createDataFrame([(k, n) for k in "ab" for n in numbers[: 5 if k == "a" else 7]], "k string, number long")
    bits = bitmaps.member_bits(df.union(df), "k")
    assert rows(bitmaps.member_count(bits, "k", name="n")) == [("a", 5), ("b", 7)]
    assert rows(bitmaps.member_count(bits, name="n")) == [(7,)]


def concentrated(n):
    """Nearly all values lie in a billionth of their range."""
    rng = random.Random(3)
    return [rng.choice([0.0, 1e6]) if i % 50 == 0 else 0.5 + rng.randrange(10**6) * 1e-15 for i in range(n)]


def test_ranks_of_concentrated_values(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 300)
    values = concentrated(6000)
    data = [(("w1", "w2")[i % 3 == 0], "cat" + str(i % 4), v) for i, v in enumerate(values)]
    df = checkpointed(spark.createDataFrame(data, "week string, category string, value double").repartition(4))
    found = ordering.with_min_ranks(
        df, {"value": {"rank_week": ["week"], "rank_category": ["week", "category"]}}
    ).collect()
    assert len(found) == len(data)
    for keys, name in ((["week"], "rank_week"), (["week", "category"], "rank_category")):
        groups = defaultdict(list)
        for r in found:
            groups[tuple(r[k] for k in keys)].append((r.value, r[name]))
        for own in groups.values():
            ordered = sorted((v for v, _ in own), reverse=True)
            first = {}
            for place, v in enumerate(ordered):
                first.setdefault(v, place + 1)
            assert all(rank == first[v] for v, rank in own)


def test_no_range_is_much_larger_than_the_others(spark):
    df = checkpointed(spark.createDataFrame([(v,) for v in set(concentrated(20_000))], "value double").repartition(4))
    placed = ranges.in_ranges(df, ["value"], range_rows=1000)
    sizes = [r[1] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == df.count() and len(sizes) >= 15
    assert max(sizes) < 2000  # the largest task: twice the wanted rows
    ends = sorted((r.part, r.low, r.high) for r in placed.groupBy("part").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_dense_numbers_have_no_gaps(spark):
    values = [f"v{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(values)
    df = checkpointed(spark.createDataFrame([(v,) for v in values], "v string").repartition(5))
    found = {r.v: r.number for r in ranges.dense_numbers(df, "v", after=10, range_rows=200).collect()}
    assert found == {v: i + 11 for i, v in enumerate(sorted(values))}
    assert ranges.dense_numbers(df.limit(0), "v").count() == 0


def test_statistics_of_concentrated_values(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 200)
    values = concentrated(3000) + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    (found,) = profile.describe(df).collect()
    ordered = sorted(v for v in values if v is not None and v == v)
    assert (found.value_ct, found.min, found.max) == (3000, 0.0, 1e6)
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        place = (len(ordered) - 1) * q
        low, high = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
        assert found[name] == pytest.approx(low + (high - low) * (place - int(place)), abs=1e-6)


def test_profiles_are_counted_while_writing(spark, small):
    m = registered.market(spark, small)
    lazy = Market(spark, roles_from_star(spark, small), registered.RULES, keep=False)
    for name in PROFILED:
        table, seen = getattr(m, name), m.profile(name)
        assert seen.row_ct == table.count()
        found = {r.column_name: r.null_ct for r in checks.null_profile(table).collect()}
        assert {c: seen.row_ct - n for c, n in seen.value_ct.items()} == found
        again = lazy.profile(name)
        assert (again.row_ct, again.value_ct) == (seen.row_ct, seen.value_ct)
    assert set(m._kept.profiles) >= {"app_dimension", "account_summary", "final", "week_activity"}


def test_bucketed_joins_have_no_exchange(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    m = Market(spark, roles_from_star(spark, small), registered.RULES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (m.final_by_account.select("acct_id", "price", "payment_type"), m.priced_by_content):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        assert rows(m.final_by_account.select(*m.final.columns)) == rows(m.final)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        folder = m.folder
        m.close()
    assert not exists(spark, folder)


def test_hot_keys_are_not_bucketed():
    assert buckets_for(10**9, 10**5) == 2048
    assert buckets_for(10**9, 3 * 10**8) == 0
    assert buckets_for(1000, 900) == 8  # small: one task takes it anyway


def test_sketches_state_their_error():
    assert sketches.DISTINCT_ERROR == pytest.approx(0.01625)


def test_late_copies_change_nothing(spark, sold, folder):
    """A day comes in parts, and a late part repeats rows that are there."""
    kinds = sold.schema
    grown = DayTable(spark, f"{folder}/distinct", kinds, "transaction_dt")
    assert grown.table.count() == 0
    early, late = sold.where("acct_id < 'u5' OR acct_id IS NULL"), sold.where("acct_id >= 'u3'")
    grown.load(early)
    before = {f for f in grown.table.inputFiles() if "2016-06-28" in f}
    grown.load(late.where(F.col("transaction_dt") > "2016-06-28"))
    assert before == {f for f in grown.table.inputFiles() if "2016-06-28" in f}  # no other day is written
    grown.load(late.unionByName(late))
    grown.load(sold.where("transaction_dt IS NULL"))
    assert rows(grown.table.select(*kinds.names)) == rows(sold.distinct())


def test_best_rows_are_kept_before_the_shuffle(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(40) if i % 11 else None, i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(4)
    found = ordering.top_per_group(df, 5, ["g"], "v", "place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    want = set()
    for group in {g for g, _, _ in data}:
        own = [(v, i) for g, v, i in data if g == group and v is not None]
        want |= {(group, v, i, 1 + sum(o > v for o, _ in own)) for v, i in own if sum(o > v for o, _ in own) < 5}
    assert {tuple(r) for r in found.collect()} == want
