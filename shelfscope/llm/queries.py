"""The registered queries of this subpackage, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import (
    decontaminate,
    divergence,
    line_crf,
    line_templates,
    near_dedup,
    nearest,
    packing,
    quality_rules,
    ranking,
    substrings,
    token_store,
    toxicity,
    warc,
)
from shelfscope.llm.shared import new_folder
from shelfscope.llm.sql import SQL as SQL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near duplicates among all documents."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and distribution divergence of all documents."""
    return quality_rules.judge(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chain of low quality, then toxicity, over all documents."""
    labels = table(spark, folder, "labels").withColumn("junk", 1 - F.col("quality"))
    return toxicity.classify(table(spark, folder, "documents"), labels, ["junk", "toxic"])


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as directly addressable codes, and read the files back."""
    path = new_folder(spark, "tokens")
    tokenizer = vocabulary("byte_bpe_50k.json")
    token_store.write_tokens(table(spark, folder, "documents"), path, tokenizer, end_id=0)
    return token_store.read_tokens(spark, path)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as seekable archives, and read the archives back."""
    path = new_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path, least_bytes=0)
    return warc.read_archives(spark, path)


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words that an earlier document has, removed from all documents."""
    found = substrings.duplicate_spans(table(spark, folder, "documents"), window=50)
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", digest)


def op8_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without lines whose template recurs across documents."""
    cleaned = line_templates.drop_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


def op9_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents from their lines."""
    docs = table(spark, folder, "documents")
    return line_crf.score(docs, line_crf.train(docs, table(spark, folder, "labels")))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into sequences of powers of two."""
    tokenizer = vocabulary("word_bpe_49k.json")
    pieces = packing.pack_documents(table(spark, folder, "documents"), tokenizer, end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return nearest.neighbours(table(spark, folder, "embeddings"), asks=F.col("vec_id") % 20 == 0)


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language of all documents differ, and by which terms."""
    return divergence.audit(table(spark, folder, "documents"))


def op13_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_store": op5_token_store,
    "op6_warc": op6_warc,
    "op7_substrings": op7_substrings,
    "op8_line_templates": op8_line_templates,
    "op9_line_crf": op9_line_crf,
    "op10_packing": op10_packing,
    "op11_nearest": op11_nearest,
    "op12_divergence": op12_divergence,
    "op13_ranking": op13_ranking,
}
