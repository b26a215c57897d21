"""Registered queries against their SQL, and the pipeline's stages."""

import corpus_pipeline
import pytest
from oracle_check import connect, differences
from pyspark.sql import functions as F
from shelfscope.llm import queries
from shelfscope.llm.shared import kept


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    df = kept(queries.QUERIES[name](spark, small), "test")
    assert differences(df, connect(small), queries.SQL[name]) == []


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = corpus_pipeline.table(spark, small, "documents").withColumn("forms", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = kept(stage(spark, docs, small), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert before < 200
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, small).count() == pieces.count()


def test_empty_documents_pass_every_stage(spark, small):
    docs = corpus_pipeline.table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, small), "test")
    assert docs.count() == 0
