"""The pipeline's stages on small documents, and its run over a table."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlife.llm import common, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, language string, ids binary, _key string"
EN = "the house and the garden with this thing {} on a long way to the town number {} and so on "


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "old", b"x", "k") for i, t, s in rows], SCHEMA)


def test_stages_keep_columns_and_clean_documents(spark):
    rows = [(i, EN.format(f"w{i * 7919}", i * 31) * 2 + f"end{i} of{i * 3} it{i * 5}", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[4][1], "s1"), (101, rows[4][1], "s2"), (102, None, "s1"), (103, "", None), (104, "123 456 !!!", "s1"), (None, rows[5][1], None)]
    rows += [(105, EN.format("a", "b") + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None)]
    docs = documents(spark, rows)
    known = corpus_pipeline.identify_language(spark, docs, "")
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in known.collect()} == {102, 103, 104}
    assert {r["language"] for r in known.collect()} == {"old"}
    lone = corpus_pipeline.drop_near_duplicates(spark, known, "")
    kept = {r["doc_id"] for r in lone.collect()}
    assert lone.columns == docs.columns and {100, 101, None} & kept == set() and {4, 5, 105} <= kept
    clean = corpus_pipeline.redact_secrets(spark, lone, "")
    assert clean.columns == docs.columns and clean.count() == lone.count()
    assert "24be64" not in clean.filter("doc_id = 105").first()["text"]
    mixed = corpus_pipeline.mix_sources(spark, clean, "")
    assert mixed.columns == docs.columns and mixed.filter("n_chars <> char_length(text)").isEmpty()
    tokens = corpus_pipeline.encode_tokens(spark, mixed, "")
    assert tokens.count() == mixed.count() and tokens.filter("not round_trip").isEmpty()


def test_stages_of_no_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
def test_run_over_a_table(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.filter("not round_trip or n_tokens is null").isEmpty() and found.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each_input(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    if name in ("op11_prefix_trie", "op13_hard_negatives"):  # nodes, and negatives in a window: beside SQL below
        assert found.count() > 0
        return
    table, rows = ("pages", 1) if name.startswith("op6") else ("embeddings", None) if name.startswith("op3") else ("documents", 1)
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert found.count() == (n if rows else 10 * len(range(0, n, 50)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    from check_oracles import compare, connect

    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op2_line_quality", "op4_mixing"])
def test_native_queries_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_release_deletes_written_tables(spark):
    df = common.stored(spark.range(3).toDF("id"), "test")
    path = common._written[-1][1].removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    held, common._written[:] = common._written[:-1], common._written[-1:]
    common.release()
    assert not os.path.isdir(path)
    common._written[:] = held
