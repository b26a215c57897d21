"""Small inputs and readable results."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shelfscope.schemas import ACCOUNT, APP, CATEGORY, DEVICE, INAPP, TRANSACTION
from shelfscope.sources.files import Roles


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    """Rows as tuples, sorted, of some columns or all."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)


def one(df, *columns):
    (row,) = rows(df, *columns)
    return row


CATEGORIES = [(1, "Entertainment"), (2, "Games"), (3, "Utilities")]
DEVICES = [(1, "Phone"), (2, "Tablet"), (3, "Both")]


def make_roles(spark, transaction=(), account=(), app=(), inapp=()):
    """Roles from plain tuples; prices may be numbers or text."""
    purchases = [
        (day(t[0]), t[1], t[2], None if t[3] is None else Decimal(str(t[3])), t[4])
        for t in transaction
    ]
    accounts = [(a[0], day(a[1]), a[2]) for a in account]
    return Roles(
        transaction=spark.createDataFrame(purchases, TRANSACTION),
        account=spark.createDataFrame(accounts, ACCOUNT),
        app=spark.createDataFrame(list(app), APP),
        inapp=spark.createDataFrame(list(inapp), INAPP),
        category=spark.createDataFrame(CATEGORIES, CATEGORY),
        device=spark.createDataFrame(DEVICES, DEVICE),
    )
