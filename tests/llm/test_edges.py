"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import public_tokenizers
import pytest
from samples import EDGES, LONG
from pyspark.sql import functions as F
from shelfscope.llm import (
    decontaminate,
    line_crf,
    line_templates,
    near_dedup,
    packing,
    quality_rules,
    substrings,
    token_store,
    toxicity,
    warc,
)
from shelfscope.llm.shared import new_folder

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def labels_of(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def stored(spark, docs):
    path = new_folder(spark, "test")
    token_store.write_tokens(docs, path, BYTES, partitions=3, shard_tokens=100_000)
    return token_store.read_tokens(spark, path) if docs.count() else docs


def archived(spark, docs):
    path = new_folder(spark, "test")
    warc.write_archives(docs, path, id_col="doc_id", url_col="lang", payload_col="text")
    return warc.read_archives(spark, path) if docs.count() else docs


OPERATORS = {
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "toxicity": lambda s, d: toxicity.classify(d, labels_of(s), ["quality", "toxic"]),
    "token_store": stored,
    "warc": archived,
    "substrings": lambda s, d: substrings.duplicate_spans(d),
    "line_templates": lambda s, d: line_templates.drop_lines(d),
    "line_crf": lambda s, d: line_crf.score(d, line_crf.train(d, labels_of(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, edges, nothing, name):
    found = OPERATORS[name](spark, edges)
    key = "page_id" if name == "warc" else "doc_id"
    ids = [r[0] for r in found.select(key).collect()]
    assert sorted(ids, key=str) == sorted([e[0] for e in EDGES], key=str)
    assert OPERATORS[name](spark, nothing).count() == 0


def test_leaks_of_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[70_000:70_040])), (2, None), (3, "")], "item_id int, text string")
    found = [tuple(r) for r in decontaminate.leaks(edges, items).collect()]
    assert found == [(4, 1, 1.0, 70_000, 70_040)]
    assert decontaminate.leaks(nothing, items).count() == 0
    assert decontaminate.leaks(edges, items.where("item_id > 5")).count() == 0


def test_packing_of_edges(spark, edges, nothing):
    pieces = packing.pack_documents(edges, WORDS)
    assert packing.pack_documents(nothing, WORDS).count() == 0
    ends = pieces.where(F.col("start") + F.col("length") == F.col("doc_tokens"))
    assert sorted([r[0] for r in ends.select("doc_id").collect()], key=str) == sorted([e[0] for e in EDGES], key=str)


def test_defined_results_of_edges(spark, edges):
    classes = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(edges).collect()}
    # Equal ids are one document, so 7 joins the copies of 6; blank texts stand alone.
    assert classes == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (None, None)}
    removed = sorted((str(r.doc_id), r.n_removed) for r in substrings.duplicate_spans(edges).collect() if r.n_removed)
    assert removed == [("7", 80)]
    kept = {r.text for r in line_templates.drop_lines(edges).collect()}
    assert kept == {t for _, t in EDGES}
