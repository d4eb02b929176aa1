import pytest
from pyspark.sql import functions as F

from prefloom.catalog.registry import QUERIES
from prefloom.schemas import EOS_TEXT

TEXTS = ["one line only", "first line\n\nsecond line\nand a last one", "ends with a break\n", "\n \n", ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    documents.withColumn("source", F.lit("web")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_versions_hold_whole_texts(spark, folder):
    rows = QUERIES["write_versioned"](spark, folder).collect()
    assert {int(r.id): r.summary for r in rows} == dict(enumerate(TEXTS))


def test_responses_are_whole_texts(spark, folder):
    rows = QUERIES["format_response"](spark, folder).collect()
    assert {r.id: r.sft_response for r in rows} == {i: f" {t}{EOS_TEXT}" for i, t in enumerate(TEXTS)}


def test_responses_of_summaries_stand_beside_those_of_whole_texts(spark, folder):
    rows = QUERIES["format_response"](spark, folder).collect()
    assert {r.id: r.summary_response for r in rows} == {i: f" {t.rpartition(chr(10))[2]}{EOS_TEXT}" for i, t in enumerate(TEXTS)}


def test_whole_texts_follow_their_queries(spark, folder):
    rows = QUERIES["join_query_response"](spark, folder).collect()
    assert {r.id: r.query_and_response for r in rows} == {i: f"{t.strip()} {t}" for i, t in enumerate(TEXTS)}


def test_summaries_follow_their_queries_too(spark, folder):
    rows = QUERIES["join_query_response"](spark, folder).collect()
    assert {r.id: r.query_and_summary for r in rows} == {i: f"{t.strip()} {t.rpartition(chr(10))[2]}" for i, t in enumerate(TEXTS)}
