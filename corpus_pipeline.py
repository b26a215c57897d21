"""A training corpus from raw documents: quality, lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import decontaminate, line_crf, line_templates, near_dedup, packing
from shelfscope.llm.queries import table, vocabulary
from shelfscope.llm.shared import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Fixed value: Spark's own setting.
SPARK_BATCH_ROWS = "10000"


def in_small_batches(stage: Stage) -> Stage:
    """The stage with Arrow batches of 1,000 whole texts, unless the session has another number than Spark's own.

    A batch lies in the memory of both the executor and its Python worker; ten thousand texts are 35 MB and
    more on either side, twice where texts go back. The result is computed after the stage returns, so the
    session keeps the setting.
    """

    def bounded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        if spark.conf.get(BATCH_ROWS) == SPARK_BATCH_ROWS:
            spark.conf.set(BATCH_ROWS, "1000")
        return stage(spark, docs, folder)

    return bounded


def good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose lines are good by the field learned from the labels."""
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, folder, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that recur across documents, and with their new length.

    A class of near copies counts as one document here, so that copies keep their text for the next stage,
    which leaves one of them. A document without id is in no class.
    """
    cleaned = line_templates.drop_lines(docs, classes=near_dedup.near_duplicates(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the least id of each class of near duplicates; all rows of that id stay."""
    copies = near_dedup.near_duplicates(docs).where("NOT is_first").select("doc_id")
    return docs.join(copies.distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaked = decontaminate.leaks(docs, table(spark, folder, "benchmark")).select("doc_id")
    return docs.join(leaked.distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of powers of two, one piece of a document each."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", in_small_batches(good)),
    ("line dedup", in_small_batches(without_repeated_lines)),
    ("near dedup", in_small_batches(one_of_each)),
    ("decontamination", in_small_batches(without_leaks)),
    ("packing", in_small_batches(packed)),
]

#: SQL has no tokenizer. Tests hold parts of the operators against brute force, but not the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, folder), name.replace(" ", "_"))
    return docs
