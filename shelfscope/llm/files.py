"""Binary files on any file system Spark reaches, written by its own sinks and read by its sources.

The text sink writes a row's bytes and then a line separator. With one row to a file, and the
last bytes of the format as the separator, the files are byte-exact and nothing but Spark's
committer places them, so lost tasks leave no halves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_binary(df: DataFrame, column: str, path: str, ending: bytes) -> None:
    """A file for each row: the bytes of ``column``, then ``ending``."""
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")  # of the separator: one byte a character
        .option("lineSep", ending.decode("latin-1"))
        .text(path)
    )


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of path and content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
