"""The stages on small and on empty tables, and the registered queries at the smallest size."""

from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import queries


def test_stages_keep_columns_and_shrink(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
        after = docs.count()
        assert docs.columns == columns and 0 < after <= before
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before


def test_stages_on_odd_rows(spark, sf):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, text + " more", "en", "a", 1), (2, text, None, None, None), (None, text, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.staged(stage(spark, kept, sf), "stage")
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, None]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


def test_tokens_take_one_python_worker_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    plan = corpus_pipeline.token_stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", [f"op{k}_" for k in range(1, 11)])
def test_queries_give_every_row(spark, sf, name):
    query = next(q for n, q in queries().items() if n.startswith(name))
    table = "pages" if name in ("op5_", "op8_") else "documents"
    rows = query(spark, sf).count()
    if name != "op2_":
        assert rows == spark.read.parquet(f"{sf}/{table}.parquet").count()
