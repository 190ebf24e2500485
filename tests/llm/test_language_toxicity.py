"""Language and toxicity: held-out accuracy, missing evidence, degenerate inputs."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlife.llm import language_id, toxicity

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
SCHEMA = "doc_id bigint, text string, lang string, source string, language string, _evidence int"
EN, DE = "the house and the garden with this thing ", "das haus und der garten mit diesem ding "


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, (EN if i % 2 else DE) * (i % 5 + 1), "en" if i % 2 else "de", f"s{i % 2}", "x", 1) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@needs_tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"), fit_rows=300)
    found = language_id.identify(docs.filter("doc_id % 2 = 1"), model, host_col="source")
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("double")), F.avg(F.col("recognised").cast("double"))).first()
    assert right[0] > 0.97 and right[1] > 0.97


def test_missing_and_extreme_texts(spark, small):
    model = language_id.fit(small)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, EN), (4, EN), (None, DE), (5, EN * 20_000), (6, "日本語の文章です。")]
    df = spark.createDataFrame([(i, t, None, None, "old", 7) for i, t in rows], SCHEMA)
    for keep in (True, False):
        found = language_id.identify(df, model, host_col="source", keep_text=keep).collect()
        assert len(found) == len(rows) and found[0]["_evidence"] == 7
        by = {r["doc_id"]: r for r in found}
        assert not by[1]["recognised"] and not by[2]["recognised"] and not by[3]["recognised"]
        assert by[4]["language"] == by[5]["language"] == "en" and by[4]["recognised"] and by[None]["language"] == "de"
    assert language_id.identify(df.limit(0), model, host_col="source").count() == 0
    empty = language_id.fit(df)  # no labels
    assert empty.languages == [] and language_id.identify(df, empty).filter("recognised").count() == 0


def test_other_evidence_decides_where_the_text_is_silent(spark, small):
    model = language_id.fit(small)
    rows = [(i, EN if i % 2 else DE, f"http://www.{'a' if i % 2 else 'b'}.{'uk' if i % 2 else 'de'}/x", "en-GB" if i % 2 else "de") for i in range(200)]
    rows += [(900, "1", "http://new.de/", None), (901, "2", None, "EN"), (902, "3", "http://x.a.uk/", None), (903, "4", None, None), (904, "5", "odd", "?!")]
    df = spark.createDataFrame(rows, "doc_id int, text string, url string, declared string")
    found = {r["doc_id"]: r for r in language_id.identify(df, model, url_col="url", declared_col="declared").collect()}
    assert found[900]["language"] == "de" and found[901]["language"] == "en" and found[902]["language"] == "en"
    assert found[900]["probability"] > 0.8 and not found[900]["recognised"] and len(found) == len(rows)


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels.filter(~held), rounds=8)
    found = toxicity.score(docs.select("doc_id", "text"), model).join(labels.filter(held), "doc_id").select("score", "toxic").collect()
    hit = sum(r["toxic"] == 1 and r["score"] >= 0.3 for r in found)
    assert hit / sum(r["toxic"] == 1 for r in found) > 0.85
    assert hit / sum(r["score"] >= 0.3 for r in found) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found)


def test_features_count_what_they_name():
    table = toxicity.Words({"zork": 2.0, "blar*": 1.0})
    plain, rude = table.features(["a quiet day", "YOU id1ot!! zork blarney, you are a sooo st.u.p.i.d"])
    at = toxicity.FEATURES.index
    assert plain[at("fixed_hits")] == plain[at("learned_weight")] == plain[at("obfuscated")] == 0
    assert rude[at("undone_hits")] > 0.9 and rude[at("obfuscated")] > 0 and rude[at("stretched")] > 0
    assert rude[at("learned_most")] == 2.0 and rude[at("near_second")] > 0 and rude[at("shouted")] > 0 and rude[at("exclamations")] > 0
    assert table.features([None, "", " "]) == [[0.0] * len(toxicity.FEATURES)] * 3


def test_toxicity_of_degenerate_inputs(spark):
    schema = "doc_id bigint, text string, score int, _raw string"
    docs = spark.createDataFrame([(1, None, 1, "r"), (2, "", 1, "r"), (3, "you idiot " * 30_000, 1, "r"), (3, "you idiot", 1, "r"), (None, "x", 1, "r")], schema)
    label = "doc_id bigint, toxic int"
    for rows in ([], [(1, 0), (2, 0)], [(None, 1), (3, None), (3, 2)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, label))
        found = toxicity.score(docs, model).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found) and found[0]["_raw"] == "r"
    many = spark.createDataFrame([(i, "you idiot" if i % 3 == 0 else "a fine day", 1, "r") for i in range(200)], schema)
    model = toxicity.fit(many, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(3, 0)], label), rounds=3)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs.unionByName(many), model).collect()}
    assert found[6] > 0.5 > found[7] and toxicity.score(docs.limit(0), model).count() == 0
