"""Input schemas and the fixed values every table shares."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


TRANSACTION = _table(
    ("create_dt", T.DateType()),
    ("content_id", T.StringType()),
    ("acct_id", T.StringType()),
    ("price", MONEY),
    ("device_id", T.IntegerType()),
)
ACCOUNT = _table(
    ("acct_id", T.StringType()),
    ("create_dt", T.DateType()),
    ("payment_type", T.StringType()),
)
APP = _table(
    ("content_id", T.StringType()),
    ("app_name", T.StringType()),
    ("category_id", T.IntegerType()),
    ("device_id", T.IntegerType()),
)
INAPP = _table(
    ("parent_app_content_id", T.StringType()),
    ("content_id", T.StringType()),
    ("type", T.StringType()),
)
CATEGORY = _table(("category_id", T.IntegerType()), ("category_name", T.StringType()))
DEVICE = _table(("device_id", T.IntegerType()), ("device_name", T.StringType()))

# File of each input table.
INPUT_FILES = {
    "transaction": ("transaction_dat.csv", TRANSACTION),
    "account": ("account_dat.csv", ACCOUNT),
    "app": ("app_dat.csv", APP),
    "inapp": ("in-app_dat.csv", INAPP),
    "category": ("category_ref.csv", CATEGORY),
    "device": ("device_ref.csv", DEVICE),
}

# Average days of a month and of a year.
DAYS_PER_MONTH = 30.436875
DAYS_PER_YEAR = 365.2425

# Tenure band labels and their inner upper edges in months.
TENURE_LABELS = [
    "no account",
    "1 month",
    "2- 6 months",
    "6 months - 1 year",
    "1- 3 years",
    "3 - 5 years",
    "5 years+",
]
TENURE_LABELS_RECUT = ["transactions without account", *TENURE_LABELS[1:]]
TENURE_EDGES = [0, 1, 6, 12, 36, 60]

# Price band labels and their upper edges; the last band is open.
PRICE_LABELS = ["free", "below $ 5", "$ 5-10", "$ 10-20", "$20+"]
PRICE_EDGES = [0.0001, 5, 10, 20]

# Categories and the columns they get when spread out.
CATEGORY_COLUMNS = {
    "Entertainment": "entertainment",
    "Games": "games",
    "Photos & Videos": "photos_videos",
    "Social Networking": "social_networking",
    "Utilities": "utilities",
}

# Account flags.
PURCHASED = "Purchased Paid App"
FREE_ONLY = "Free Only"
DORMANT = "Dormant"
ACTIVE = "Active"

# Payment types and content types.
PAY_FREE = "Free only"
PAY_ON_FILE = "PMOF"
CONSUMABLE = "consumable"
SUBSCRIPTION = "subscription"
BOTH_DEVICES = "Both"
