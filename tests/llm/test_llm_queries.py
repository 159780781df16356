"""Registered queries, their SQL and the pipeline over the smallest tables."""

import re

import pytest

import corpus_pipeline
from checks.compare import duck, rows_of
from tollwatch.llm import darts, queries, tokens

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours = queries.QUERIES[name](spark, SMALL)
    theirs = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(
        columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_one_row_per_input_row(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name == "op3_decontamination":
        assert df.where("covered between 0.3 and 1").count() == df.count()
        return
    own = {"op4_url_filter": "count(*) from pages",
           "op12_conversation_repair": "count(distinct conv_id) from conversations"}
    counted = own.get(name, "count(*) from documents")
    assert df.count() == con.execute(f"select {counted}").fetchone()[0]


def test_each_number_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        if name == "near-duplicate removal":
            classes = darts.classes(docs).select("class_id").distinct().count()
            assert after.count() == classes
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert last.count() == docs.count() > 0 and before > 0


def test_stages_of_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == tokens.ROWS.replace(" long", "").split(", ")


def test_run_writes_every_stage_but_the_last(spark, monkeypatch):
    read = []

    def stage(name):
        def keep(spark, docs, sf_dir):
            read.append(docs.inputFiles())
            return docs.where("ran(doc_id)")
        return name, keep

    total = spark.sparkContext.accumulator(0)

    def count(_):
        total.add(1)
        return True

    spark.udf.register("ran", count, "boolean")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in ("a b", "c", "d")])
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    out = corpus_pipeline.run(spark, SMALL)
    assert total.value == 2 * n and out.count() == n
    assert "/a-b-" in read[1][0] and "/c-" in read[2][0]
