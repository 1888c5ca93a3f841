"""Operators run as they are registered, over tables of a folder."""

import pytest

import corpus_pipeline
from termloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts = {"en": "the king and the thing were there with others", "de": "der hund und die heitere zeitung schlafen dort"}
    rows = [(i, f"{texts[lang]} {i} {texts[lang][i % 7:]}", lang, "s", 0) for i, lang in enumerate(["en", "de"] * 20)] + [(40, texts["en"], None, "s", 0), (41, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "hund und die heitere zeitung"), (8, "nothing that any text has in it")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_op4_gives_a_row_per_document(spark, folder):
    got = {r["doc_id"]: r["predicted"] for r in queries.queries()["op4_string_kernel"](spark, folder).collect()}
    assert len(got) == 42 and got[40] == "en" and all(got[i] == ("en", "de")[i % 2] for i in range(40))


def test_op6_finds_items_within_the_budget(spark, folder):
    got = queries.queries()["op6_benchmark_matches"](spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 7) for i in range(1, 40, 2)}


def test_pipeline_drops_documents_that_hold_an_item(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.decontamination(spark, docs, folder)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {*range(0, 40, 2), 40, 41}
