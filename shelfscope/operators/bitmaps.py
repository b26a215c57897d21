"""Exact sets of numbered members as bitmaps, which merge where distinct counts do not.

Members have dense numbers from 1 (``ranges.dense_numbers``); a bitmap holds 32,768 of them, and a set
has a row for each bitmap that is not empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_bits(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bits) of the members (column ``number``) of each group; keys may be missing."""
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return df.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged_bits(bits: DataFrame, *keys: str) -> DataFrame:
    """The union of the sets of each group."""
    return bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def member_count(bits: DataFrame, *keys: str, name: str) -> DataFrame:
    """Distinct members of each group: union by bucket, then sum of what the buckets hold."""
    counted = merged_bits(bits, *keys).select(*keys, F.bitmap_count("bits").alias(name))
    return counted.groupBy(*keys).agg(F.sum(name).alias(name))
