import random
import statistics

import numpy as np
import pytest
from helpers import day, one, rows
from pyspark.sql import functions as F
from shelfscope.operators import checks
from shelfscope.operators.estimates import annualise, two_sample_interval
from shelfscope.operators.grouping import (
    drop_all_zero,
    fill_bands,
    index_to_lowest,
    share_of_total,
    spread_sum,
    value_counts,
)
from shelfscope.operators.joins import row_counts, with_fallback, without_ids
from shelfscope.operators.ordering import (
    last_rows,
    top_rows,
    with_change,
    with_min_ranks,
    with_previous,
)
from shelfscope.operators.profile import describe, histogram
from shelfscope.operators.ranges import in_ranges


def test_spread_sum_fills_or_keeps_missing(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 2), ("b", "y", 5), (None, "x", 9), ("c", None, 7)],
        "k string, c string, v long",
    )
    columns = {"x": "vx", "y": "vy"}
    assert rows(spread_sum(df, ["k"], "c", columns, "v")) == [("a", 3, 0), ("b", 0, 5)]
    kept = spread_sum(df, ["k"], "c", columns, "v", fill=None)
    assert rows(kept) == [("a", 3, None), ("b", None, 5)]


def test_drop_all_zero(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, -1, 1), (3, 0, 4)], "k int, a int, b int")
    assert [r[0] for r in rows(drop_all_zero(df, ["a", "b"]))] == [2, 3]


def test_fill_bands_gives_every_combination(spark):
    df = spark.createDataFrame(
        [("a", "u"), ("a", "u"), ("b", "v"), (None, "v"), ("a", None)], "band string, k string"
    )
    grouped = df.groupBy("band", "k").agg(F.count(F.lit(1)).alias("n"))
    got = rows(fill_bands(grouped, {"band": ["a", "b", "c"]}, ["k"]), "band", "k", "n")
    assert got == [
        ("a", "u", 2), ("a", "v", 0), ("b", "u", 0), ("b", "v", 1), ("c", "u", 0), ("c", "v", 0)
    ]


def test_fill_bands_of_nothing_still_lists_the_bands(spark):
    empty = spark.createDataFrame([], "band string, n long")
    assert rows(fill_bands(empty, {"band": ["a", "b"]})) == [("a", 0), ("b", 0)]


def test_fill_bands_of_two_bands(spark):
    grouped = spark.createDataFrame([("a", "x", 4)], "p string, q string, n long")
    got = rows(fill_bands(grouped, {"p": ["a", "b"], "q": ["x", "y"]}), "p", "q", "n")
    assert got == [("a", "x", 4), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]


def test_shares_and_index(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    got = rows(df.select("k", share_of_total("v"), index_to_lowest("v")))
    assert got == [("a", 0.25, 1.0), ("b", 0.75, 3.0)]


def test_value_counts_most_frequent_first(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [tuple(r) for r in value_counts(df, "k").collect()] == [("b", 2), ("a", 1)]


def test_previous_is_the_previous_observed_row(spark):
    df = spark.createDataFrame(
        [("a", day("2016-07-01"), 0), ("a", day("2016-07-04"), 6), ("b", day("2016-07-04"), 1)],
        "k string, d date, v int",
    )
    before = with_previous(df, ["k"], "d", {"v": "was"})
    got = rows(with_change(before, "v", "was", "rate", "diff"), "k", "v", "was", "rate", "diff")
    assert got == [
        ("a", 0, None, None, None), ("a", 6, 0, None, 6), ("b", 1, None, None, None)
    ]


def test_rank_of_equal_values(spark):
    df = spark.createDataFrame([("w", 30.0), ("w", 30.0), ("w", 10.0)], "w string, v double")
    got = rows(with_min_ranks(df, {"v": {"r": ["w"]}}), "v", "r")
    assert got == [(10.0, 3), (30.0, 1), (30.0, 1)]


def test_sliced_ranks_equal_brute_force(spark):
    draw = random.Random(5)
    data = [
        (draw.choice("wx"), draw.choice("abc"),
         0.0 if draw.random() < 0.35 else round(draw.lognormvariate(3, 2), 2) - 1)
        for _ in range(600)
    ]
    df = spark.createDataFrame(data, "w string, c string, v double")
    got = rows(with_min_ranks(df, {"v": {"r": ["w"], "rc": ["w", "c"]}}), "w", "c", "v", "r", "rc")
    want = sorted(
        (
            (w, c, v, 1 + sum(x == w and z > v for x, _, z in data),
             1 + sum(x == w and y == c and z > v for x, y, z in data))
            for w, c, v in data
        ),
        key=str,
    )
    assert got == want


def test_top_and_last_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "v int")
    assert [r[0] for r in top_rows(df, 2, [F.desc("v")]).collect()] == [5, 4]
    last = last_rows(df, 2, [F.asc("v")], [F.desc("v")])
    assert [r[0] for r in last.collect()] == [4, 5]


def test_without_ids_keeps_missing_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    ids = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(without_ids(df, ids, "k")) == [("b",), (None,)]


def test_fallback_rows_yield_to_content_rows(spark):
    content = spark.createDataFrame([("a", 1)], "k string, v int")
    fallback = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert rows(with_fallback(content, fallback, "k")) == [("a", 1), ("b", 3)]


def test_row_counts(spark):
    assert one(row_counts(spark.range(3), spark.range(4))) == (3, 4, False)


def test_two_sample_interval(spark):
    data = [("c", 1), ("c", 2), ("c", 3), ("t", 2), ("t", 4), ("t", 6), ("other", 99)]
    df = spark.createDataFrame(data, "g string, v int")
    r = two_sample_interval(df, "g", "c", "t", "v").first()
    se = 10**0.5 / 3
    assert (r.n_control, r.n_test, r.mean_control, r.mean_test, r.d_hat) == (3, 3, 2.0, 4.0, 2.0)
    assert r.sd_control == pytest.approx((2 / 3) ** 0.5, abs=1e-6)
    assert r.sd_test == pytest.approx((8 / 3) ** 0.5, abs=1e-6)
    assert r.variance_pool == pytest.approx(5 / 3, abs=1e-6)
    assert r.se == pytest.approx(se, abs=1e-6)
    assert r.lower_bound == pytest.approx(2 - 1.96 * se, abs=1e-6)
    assert r.upper_bound == pytest.approx(2 + 1.96 * se, abs=1e-6)
    assert r.significant is (abs(2) > 1.96 * se)


def test_annualise_scales_subscriptions_only(spark):
    df = spark.createDataFrame([("subscription", 10.0), ("consumable", 10.0)], "t string, v double")
    got = rows(annualise(df, {"v": "y"}, "t", F.lit(0.25), 0.6), "t", "y")
    assert got == [("consumable", 10.0), ("subscription", 24.0)]


@pytest.mark.parametrize("size", [1, 2, 5, 400, 30_000])
def test_describe_equals_numpy(spark, size):
    draw = random.Random(size)
    values = [
        7.0 if draw.random() < 0.3 else round(draw.lognormvariate(2, 1.5), 2) for _ in range(size)
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = describe(df, ["v"]).first()
    assert r.value_ct == size
    assert r["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6)
    assert (r["min"], r["max"]) == (min(values), max(values))
    for name, p in (("q25", 25), ("q50", 50), ("q75", 75)):
        assert r[name] == pytest.approx(float(np.percentile(values, p)), abs=1e-6)
    if size > 1:
        assert r["std"] == pytest.approx(statistics.stdev(values), abs=1e-6)


def test_describe_negative_values_and_missing(spark):
    values = [-5.0, -0.5, 0.0, 2.0, None]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int")
    got = {r.column_name: r for r in describe(df, ["v", "w"]).collect()}
    present = [v for v in values if v is not None]
    assert got["v"].value_ct == 4
    assert got["v"].q25 == pytest.approx(float(np.percentile(present, 25)))
    assert got["v"].q75 == pytest.approx(float(np.percentile(present, 75)))
    assert (got["w"].q50, got["w"].std) == (1.0, 0.0)


def test_histogram_equals_numpy(spark):
    draw = random.Random(3)
    values = [draw.uniform(-1, 12) for _ in range(500)] + [0.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = histogram(df, "v", 8, 0, 10).orderBy("bin").collect()
    inside = np.histogram(values, bins=8, range=(0, 10))[0].tolist()
    below, above = sum(v < 0 for v in values), sum(v > 10 for v in values)
    assert [r.row_ct for r in got] == [below, *inside, above]
    assert (got[0].bin_start, got[0].bin_end, got[-1].bin_start, got[-1].bin_end) == (None, 0, 10, None)
    free = histogram(df, "v", 8).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=8)
    assert [r.row_ct for r in free] == [0, *counts.tolist(), 0]
    assert [r.bin_start for r in free[1:-1]] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (float("nan"),), (None,)], "v double")
    assert [r.row_ct for r in histogram(df, "v", 2).orderBy("bin").collect()] == [0, 2, 0, 0]
    assert sum(r.row_ct for r in histogram(df.where("v < 0"), "v", 2).collect()) == 0


def test_describe_takes_numeric_columns_and_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (float("nan"), 2, "b")], "v double, w int, s string")
    got = {r.column_name: r for r in describe(df).collect()}
    assert set(got) == {"v", "w"}
    assert (got["v"].value_ct, got["v"]["mean"], got["w"].q50) == (1, 1.0, 1.5)


def test_values_close_together_are_spread_over_slices(spark):
    """200,000 ids within one doubling."""
    df = spark.range(1_000_000, 1_200_000).withColumn("v", F.col("id").cast("double"))
    placed = in_ranges(df, ["v"], range_rows=5000).groupBy("part")
    sizes = placed.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    got = sizes.orderBy("part").collect()
    assert len(got) == 40 and max(r.n for r in got) < 10_000
    assert all(x.b < y.a for x, y in zip(got, got[1:]))
    assert describe(df.select("v")).first().q25 == 1_049_999.75


def test_null_and_column_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(checks.null_profile(df)) == [("a", 0), ("b", 1)]
    assert rows(checks.column_profile(df)) == [("a", "int", 2), ("b", "string", 1)]


def test_duplicate_stats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert one(checks.duplicate_stats(df)) == (3, 2, 1, 33.33, False)
    assert one(checks.duplicate_stats(df.distinct())) == (2, 2, 0, 0.0, True)


def test_period_counts_missing_days(spark):
    df = spark.createDataFrame(
        [(day("2016-06-01"),), (day("2016-06-02"),), (day("2016-06-02"),), (day("2016-06-05"),)],
        "d date",
    )
    got = checks.period(df, "d").first()
    assert (got.period_start, got.period_end) == (day("2016-06-01"), day("2016-06-05"))
    assert (got.period_days, got.missing_days, got.period_ratio) == (4, 2, 4 / 365)


def test_ambiguous_names_and_orphans(spark):
    apps = spark.createDataFrame(
        [("1", "x"), ("2", "x"), ("3", "y"), ("4", None)], "id string, n string"
    )
    assert rows(checks.ambiguous_names(apps, "n", "id")) == [("x", 2)]
    fact = spark.createDataFrame([("1",), ("9",), ("9",)], "id string")
    assert rows(checks.orphan_keys(fact, apps, "id")) == [("9", 2)]
