"""Logistic models on a driver's sample, and the choice of such samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.shared import kept


def in_training(id_column: Column) -> Column:
    """Rows to learn from: those whose id's CRC-32 leaves a remainder modulo five."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 != 0


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by the hash of ``id``: a filter, so any number of rows may come."""
    n = rows.count()
    if n <= most:
        return rows
    share = most / n
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def sampled(rows: DataFrame, labels: DataFrame, columns: Sequence[str], most: int, most_bytes: int) -> pa.Table:
    """Texts (text) and labels to learn from, on the driver, in the order of the ids' hashes.

    ``rows`` has id and text, ``labels`` has id and ``columns``. Ids with a null label, or with labels that
    contradict each other, are left out; of several texts of an id, the one of least hash is taken. The
    sample has about ``most`` texts at most, and about ``most_bytes`` of them, none longer than that.
    """
    same = [F.min(c) == F.max(c) for c in columns]
    known = labels.dropna().groupBy("id").agg(*[F.min(c).alias(c) for c in columns], F.array(*same).alias("same"))
    known = known.where(F.forall("same", lambda x: x)).drop("same")
    learn = bounded(known.where(in_training(F.col("id"))), most)
    fitting = rows.join(F.broadcast(learn), "id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    one = fitting.groupBy("id", *columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = kept(one, "sample")
    total = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        one = one.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) < int(most_bytes / total * (1 << 30)))
    found = one.select("text", *columns, F.xxhash64("id").alias("order")).toArrow().sort_by("order")
    return found.drop_columns(["order"]).combine_chunks()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 25) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge on the weights."""
    ones = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(ones.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(turns):
        p = sigmoid(ones @ w)
        slope = ones.T @ (p - y) + penalty * w
        curve = (ones * (p * (1 - p))[:, None]).T @ ones + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
