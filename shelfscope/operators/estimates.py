"""Two-sample comparison and annual estimates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numbers import ratio
from shelfscope.schemas import SUBSCRIPTION


def two_sample_interval(
    df: DataFrame, group: str, control: str, test: str, value: str, z: float = 1.96
) -> DataFrame:
    """Difference of two group means with pooled variance and its interval, as one row.

    Variances are those of the population (divided by n); the pooling weighs them by n - 1.
    Everything comes from one pass over ``df``.
    """
    number = F.col(value).cast("double")

    def of(label: str) -> list[Column]:
        mine = F.when(F.col(group) == F.lit(label), number)
        return [F.count(mine), F.avg(mine), F.var_pop(mine)]

    names = ["n_control", "mean_control", "var_control", "n_test", "mean_test", "var_test"]
    sides = [c.alias(n) for c, n in zip(of(control) + of(test), names)]
    weight_control = F.col("n_control") - 1
    weight_test = F.col("n_test") - 1
    pooled = ratio(
        weight_control * F.col("var_control") + weight_test * F.col("var_test"),
        weight_control + weight_test,
    )
    one = F.lit(1.0)
    spread = F.sqrt(ratio(one, F.col("n_control")) + ratio(one, F.col("n_test")))
    return (
        df.filter(F.col(group).isin(control, test))
        .agg(*sides)
        .withColumn("d_hat", F.col("mean_test") - F.col("mean_control"))
        .withColumn("variance_pool", pooled)
        .withColumn("se", F.sqrt("variance_pool") * spread)
        .withColumn("margin", F.col("se") * F.lit(z))
        .select(
            "n_control",
            "n_test",
            *[F.round(c, 6).alias(c) for c in ("mean_control", "mean_test")],
            F.round(F.sqrt("var_control"), 6).alias("sd_control"),
            F.round(F.sqrt("var_test"), 6).alias("sd_test"),
            *[F.round(c, 6).alias(c) for c in ("d_hat", "variance_pool", "se", "margin")],
            F.round(F.col("d_hat") - F.col("margin"), 6).alias("lower_bound"),
            F.round(F.col("d_hat") + F.col("margin"), 6).alias("upper_bound"),
            (F.abs("d_hat") > F.col("margin")).alias("significant"),
        )
    )


def annualise(
    df: DataFrame,
    columns: Mapping[str, str],
    kind: str,
    period_share: Column,
    retention: float = 0.6,
    subscription: str = SUBSCRIPTION,
) -> DataFrame:
    """Scale subscription measures to a year and by retention; other rows keep the value."""
    scaled = {}
    for old, new in columns.items():
        value = F.col(old).cast("double")
        yearly = value * ratio(F.lit(1.0), period_share) * F.lit(retention)
        scaled[new] = F.when(F.col(kind) == subscription, yearly).otherwise(value)
    return df.withColumns(scaled)
