"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.schemas import INPUT_FILES


@dataclass(frozen=True)
class Roles:
    """The six input tables, with the columns of their files."""

    transaction: DataFrame
    account: DataFrame
    app: DataFrame
    inapp: DataFrame
    category: DataFrame
    device: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# The dialect of pandas and spreadsheets: a quote in a quoted field is doubled.
DIALECT = {"header": True, "quote": '"', "escape": '"'}

# Places kept beyond those of a decimal type, to tell a finer value from a fitting one.
SPARE = 6


def _loose(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + SPARE), kind.scale + SPARE)
    return kind


def _exact(column: Column, kind: T.DataType) -> Column:
    """The value in its type; an error where a decimal would be rounded or does not fit."""
    if not isinstance(kind, T.DecimalType):
        return column
    fits = column.cast(kind)
    message = F.concat(F.lit(f"does not fit {kind.simpleString()}: "), column.cast("string"))
    return F.when(column.isNull() | (column.try_cast(kind) == column), fits).otherwise(
        F.raise_error(message).cast(kind)
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    date_format: str = "yyyy-MM-dd",
    line_breaks: bool = False,
) -> DataFrame:
    """Scan with a given schema. Columns are found by name, in any order; others are left out.

    A missing column is an error, and so is a CSV value that does not fit its type or a decimal
    with more places than its type has. ``line_breaks`` allows them inside quoted fields; Spark
    cannot split such a file between tasks, so it is for small tables.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    options = {**DIALECT, "multiLine": line_breaks}
    found = spark.read.options(**options).csv(path).columns
    if missing := [name for name in schema.names if name not in found]:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    wanted = {field.name: _loose(field.dataType) for field in schema}
    stored = T.StructType([T.StructField(n, wanted.get(n, T.StringType())) for n in found])
    scan = spark.read.schema(stored).options(**options)
    scan = scan.csv(path, dateFormat=date_format, mode="FAILFAST", enforceSchema=False)
    return scan.select(*[_exact(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema])


def read_roles(spark: SparkSession, folder: str) -> Roles:
    """The six CSV files of a folder. Only the purchases are read in splits, without line breaks
    in their fields, which are ids, days and prices."""
    return Roles(
        **{
            role: read_table(spark, f"{folder}/{name}", schema, line_breaks=role != "transaction")
            for role, (name, schema) in INPUT_FILES.items()
        }
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()
) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**DIALECT).csv(path)
    else:
        writer.format(fmt).save(path)
