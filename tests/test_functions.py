import datetime as dt

import pytest
from helpers import day, one, rows
from pyspark.sql import functions as F
from shelfscope.functions import bands, dates, numbers, text
from shelfscope.schemas import TENURE_LABELS_RECUT


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("  it's 3d: chess-pro (HD)", "It'S 3D Chesspro Hd"),
        ("plain name ", "Plain Name"),
        ("\tTabbed;APP,", "Tabbedapp"),
        ("école 2b", "École 2B"),
        ("中a ok", "中A Ok"),
        ("", ""),
    ],
)
def test_clean_app_name(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "name string")
    assert one(df.select(text.clean_app_name(F.col("name")))) == (clean,)


def test_clean_app_name_keeps_long_words_whole_and_nulls(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long,), (None,)], "name string")
    got = {r[0] for r in df.select(text.clean_app_name(F.col("name"))).collect()}
    assert got == {"X" + "x" * 4999, None}


def test_title_words_agrees_with_python(spark):
    samples = ["a1b2", "O'NEIL mc-donald", "HELLO world", "x_y z", "é1é", "10th aVe."]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(text.title_words(F.col("s"))).collect()]
    assert got == [s.title() for s in samples]


def test_tenure_band_edges(spark):
    months = [-2.0, 0.0, 0.5, 6.0, 70.0, None]
    df = spark.createDataFrame([(m,) for m in months], "m double")
    got = [
        r[0]
        for r in df.select(bands.tenure_band(F.col("m"), F.lit(-2.0), F.lit(70.0))).collect()
    ]
    assert got == [None, "no account", "1 month", "2- 6 months", "5 years+", None]


def test_tenure_band_outside_given_edges_has_no_label(spark):
    df = spark.createDataFrame([(-1.0,), (80.0,), (-3.0,)], "m double")
    band = bands.tenure_band(F.col("m"), F.lit(-2.0), F.lit(70.0), TENURE_LABELS_RECUT)
    assert [r[0] for r in df.select(band).collect()] == ["transactions without account", None, None]


def test_price_band_edges(spark):
    df = spark.createDataFrame(
        [("0.00",), ("0.99",), ("5.00",), ("5.01",), ("20.00",), ("25.00",), (None,)], "p string"
    ).select(F.col("p").cast("decimal(8,2)").alias("p"))
    got = [r[0] for r in df.select(bands.price_band(F.col("p"))).collect()]
    assert got == ["free", "below $ 5", "below $ 5", "$ 5-10", "$ 10-20", "$20+", "free"]


def test_calendar(spark):
    df = spark.createDataFrame([(day("2016-07-04"),), (day("2016-07-10"),)], "d date")
    d = F.col("d")
    got = rows(
        df.select(
            dates.weekday_number(d),
            dates.weekday_name(d),
            dates.iso_week(d),
            dates.week_start(d),
            dates.year_month(d),
        )
    )
    monday = dt.date(2016, 7, 4)
    assert got == [
        (0, "Monday", 27, monday, "2016-07"),
        (6, "Sunday", 27, monday, "2016-07"),
    ]


def test_days_seen(spark):
    listed = ["2016-07-04", "2016-07-04", "2016-07-10", "2016-07-31", "2016-07-01"]
    df = spark.createDataFrame([(day(x),) for x in listed], "d date")
    week = df.filter(F.col("d").between("2016-07-04", "2016-07-10"))
    assert one(week.agg(dates.days_seen_in_week("d"))) == (2,)
    assert one(df.agg(dates.days_seen_in_month("d"))) == (4,)


def test_average_month_and_year(spark):
    df = spark.createDataFrame([(365,)], "d int")
    months, years = one(df.select(dates.months_in(F.col("d")), dates.years_in(F.col("d"))))
    assert months == 365 / 30.436875
    assert years == 365 / 365.2425


def test_zero_divisor_gives_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    both = df.select(numbers.ratio("a", "b"), numbers.change_rate("a", "b"))
    got = [tuple(r) for r in both.collect()]
    assert got == [(None, None), (None, None), (2.0, 1.0)]


def test_unknown_condition_is_zero(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert [r[0] for r in df.select(numbers.flag(F.col("x") > 0)).collect()] == [1, 0, 0]
