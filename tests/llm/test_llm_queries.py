"""Registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from check_queries import connect, difference
from supplyloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    con: duckdb.DuckDBPyConnection = connect(FOLDER)
    for key, sql in queries.SQL.items():
        assert difference(queries.QUERIES[key](spark, FOLDER).toPandas(), con.execute(sql).fetchdf()) is None


@pytest.mark.parametrize("key", ["op3_source_mixture", "op5_exact_dedup", "op9_rendezvous_shards"])
def test_native_plans_hold_no_python(spark, key):
    plan = queries.QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("key", ["op2_quality_classifier", "op4_toxicity", "op6_ngram_join"])
def test_one_row_per_document(spark, key):
    ids = [r.doc_id for r in queries.QUERIES[key](spark, FOLDER).select("doc_id").collect()]
    assert sorted(ids) == list(range(200))


def test_held_out_quality(spark):
    """Held-out accuracy on the largest table that tests use."""
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op2_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixture", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString()
        if name != "mixture":
            assert 0 < out.count() <= before
            assert out.exceptAll(docs).isEmpty()
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, FOLDER).columns == packed.columns
