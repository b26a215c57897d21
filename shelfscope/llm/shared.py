"""What the operators share: their input columns, and tables and folders that all machines see."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.sources.kept import delete_folder, shared_folder

#: Bytes of text that a task holds as arrays at once; a longer single text is taken alone.
CHUNK_BYTES = 8 << 20


_made: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of ``spark.checkpoint.dir``, or of the warehouse if unset."""
    path = f"{shared_folder(spark)}/shelfscope-llm/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote in folders of their own.

    DataFrames that they returned may read from there, so this comes when the results are in place.
    """
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete_folder(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written to a folder of its own and read from there: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_idle() -> None:
    """Free what tasks of other operators left in this worker, which Spark uses again: a vocabulary's cache of
    pieces, and Arrow's pool of freed memory."""
    tokens = sys.modules.get("shelfscope.llm.tokens")
    if tokens:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else there is, is left out."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def same(left: Column, right: Column) -> Column:
    """Equality that also holds between two nulls."""
    return left.eqNullSafe(right)


def chunks(
    batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, most_lines: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose ``column`` has about ``limit`` bytes, and ``most_lines`` line feeds."""
    texts = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    breaks = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy() if most_lines else lengths * 0
    first, total, lines = 0, 0, 0
    for row, (length, n) in enumerate(zip(lengths, breaks)):
        if row > first and (total and total + length > limit or most_lines and lines + n > most_lines):
            yield batch.slice(first, row - first)
            first, total, lines = row, 0, 0
        total += int(length)
        lines += int(n) + 1
    if first < batch.num_rows:
        yield batch.slice(first)
