"""Tables of distinct rows that grow: a folder for each day, so that copies meet within a day alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.sources.kept import checkpointed, exists


class DayTable:
    """Distinct rows of a schema below a folder, by the values of its column ``day``.

    Exact copies share their day, so new rows are compared with the stored ones of their own days, and
    only these days are written. The rows of a day are spread by a hash of all their columns, so a day with
    very many of them is no hot spot. A missing day is a day of its own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, day: str, keep=checkpointed):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._schema = schema
        self._day = day
        self._keep = keep

    @property
    def table(self) -> DataFrame:
        if not exists(self._spark, self._folder):
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(self._folder).select(*self._schema.names)

    def load(self, rows: DataFrame) -> None:
        """Add the rows that are not there yet; loading the same ones again changes nothing.

        Copies collapse in each partition before the shuffle. A load that broke off leaves each day as it was
        or as it should be, so it can be repeated.
        """
        rows = rows.select(*self._schema.names)
        # Days are few, whatever the rows.
        days = [row[0] for row in rows.select(self._day).distinct().collect()]
        if not days:
            return
        stored = self.table.where(self._among(days))
        # Stored before it is written over what it was read from.
        merged = self._keep(rows.unionByName(stored).distinct())
        writer = merged.hint("rebalance", F.col(self._day)).write.mode("overwrite").partitionBy(self._day)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self._folder)

    def _among(self, days: list) -> Column:
        column = F.col(self._day)
        found = column.isin([day for day in days if day is not None])
        return found | column.isNull() if None in days else found
