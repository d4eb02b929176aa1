import json

import pytest
from pyspark.sql import functions as F

from prefloom.functions.tokens import WordTokenizer
from prefloom.operators import records as rec
from prefloom.plans.examples import build_preference_pairs, prepare_comparisons
from prefloom.schemas import COMPARISON, EOS_TEXT, PairParams, PromptParams
from prefloom.sources import feedback


def record(**changes):
    row = {
        "info": {"id": "1", "post": "a post", "title": "t", "subreddit": "s"},
        "summaries": [{"text": " first one", "policy": "p", "note": "n"}, {"text": "second", "policy": "q", "note": None}],
        "choice": 0,
        "worker": "w",
        "batch": "batch3",
        "split": "train",
        "extra": {},
    }
    return {**row, **changes}


def frame(spark, *records):
    return spark.createDataFrame([json.dumps(r) for r in records], "string").select(F.from_json("value", COMPARISON).alias("r")).select("r.*")


def write_lines(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def test_absent_keys_read_as_null(spark, tmp_path):
    bare = record()
    del bare["extra"]
    path = write_lines(tmp_path / "a.json", record(), bare, record(extra={"confidence": 4}))
    rows = feedback.read_comparisons(spark, path).collect()
    assert [r.info.site for r in rows] == [None] * 3 and [r.info.article for r in rows] == [None] * 3
    assert sorted(str(r.extra and r.extra.confidence) for r in rows) == ["4", "None", "None"]
    axis = {"info": {"id": "1"}, "summary": {"text": "x", "axes": {"overall": 5}}, "split": "test"}
    row = feedback.read_axis_evals(spark, write_lines(tmp_path / "b.json", axis)).first()
    assert row.summary.axes.overall == 5 and row.summary.axes.compatible is None and row.info.post is None


def test_malformed_lines_fail(spark, tmp_path, failing):
    (tmp_path / "bad.json").write_text('{"choice": "not a number"}\n')
    assert "MALFORMED" in failing(feedback.read_comparisons(spark, str(tmp_path / "bad.json"))).upper()


def test_unknown_kind_and_published_files(spark):
    with pytest.raises(ValueError, match="unknown feedback kind"):
        feedback.read_feedback(spark, "rankings", "nowhere")
    assert len(feedback.COMPARISON_FILES) == 23 and len(feedback.AXIS_FILES) == 5
    assert "root/axis_evals/cnndm1.json" in feedback.published_paths("axis", "root/")


def test_route_split(spark, failing):
    rows = rec.route_split(frame(spark, *[record(split=s) for s in ("train", "valid1", "valid2")]))
    assert sorted(r.split for r in rows.collect()) == ["train", "validation", "validation"]
    assert "holdout is an unrecognized dataset split" in failing(rec.route_split(frame(spark, record(split="holdout"))))
    assert "NULL is an unrecognized" in failing(rec.route_split(frame(spark, record(split=None))))
    assert rec.route_split(frame(spark, record(split="test")), rec.AXIS_SPLITS).first().split == "test"


def test_news_batches_leave_validation_only(spark):
    rows = [record(split=s, batch=b) for s in ("train", "valid1") for b in ("cnndm0", "batch3", None)]
    kept = {(r.split, r.batch) for r in prepare_comparisons(frame(spark, *rows)).collect()}
    assert kept == {("train", "cnndm0"), ("train", "batch3"), ("train", None), ("validation", "batch3"), ("validation", None)}


@pytest.mark.parametrize("choice, chosen, rejected", [(0, " first one", "second"), (1, "second", " first one")])
def test_pick(spark, choice, chosen, rejected):
    row = rec.pick_chosen_rejected(frame(spark, record(choice=choice))).first()
    assert (row.chosen, row.rejected) == (chosen, rejected)


@pytest.mark.parametrize("choice", [2, -1])
def test_wrong_choice_fails(spark, failing, choice):
    assert f"choice must be 0 or 1, got {choice}" in failing(rec.pick_chosen_rejected(frame(spark, record(choice=choice))))


def test_length_stats_and_counts(spark):
    rows = frame(spark, record(), record(choice=1), record(split="valid1"))
    stats = {r.split: r for r in rec.response_length_stats(rec.route_split(rows), WordTokenizer()).collect()}
    assert (stats["train"].n_responses, stats["train"].max_length, stats["train"].mean_length) == (4, 3, 2.5)
    assert {tuple(r) for r in rec.split_counts(rec.route_split(rows)).collect()} == {("train", 2), ("validation", 1)}


def test_pairs_join_with_and_without_a_blank(spark):
    tokenizer = WordTokenizer()
    row = build_preference_pairs(frame(spark, record()), PairParams(budget=20, response_width=4, total_width=24)).first()
    query = "SUBREDDIT: r/s\n\nTITLE: t\n\nPOST: a post\n\nTL;DR:"
    assert row.query == query and row.status == "ok"
    for side, text in (("chosen", " first one"), ("rejected", "second")):
        joined = query + text + EOS_TEXT
        assert row[f"query_and_{side}_response"] == joined
        expected = spark.createDataFrame([(joined, text + EOS_TEXT)], ["t", "r"]).select(tokenizer.encode(F.col("t")).alias("t"), tokenizer.encode(F.col("r")).alias("r")).first()
        assert row[f"query_and_{side}_response_tokens"] == (expected.t + [0] * 24)[:24]
        assert row[f"{side}_response_tokens"] == (expected.r + [0] * 4)[:4]
    assert len(row.query_tokens) == 20


def test_null_title_and_over_budget(spark):
    info = {"id": "1", "post": "p", "title": None, "subreddit": "s"}
    assert "TITLE: None" in build_preference_pairs(frame(spark, record(info=info))).first().query
    row = build_preference_pairs(frame(spark, record()), PairParams(budget=3)).first()
    assert row.status == "over_budget" and row.query is None and row.query_and_chosen_response_tokens is None
    assert PairParams(null_text="").null_text == "" and PromptParams().budget == 512


def test_projection_reads_needed_columns_only(spark, tmp_path):
    spark.range(3).selectExpr("id", "array(id) as query_tokens", "'x' as response").write.parquet(str(tmp_path / "t"))
    df = rec.project_for(spark.read.parquet(str(tmp_path / "t")), "rollout")
    assert "ReadSchema: struct<query_tokens:array<bigint>>" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown task"):
        rec.project_for(df, "ppo")


def test_assemble_splits(spark):
    out = rec.assemble_splits(train=spark.range(2), validation=spark.range(1))
    assert sorted(map(tuple, out.collect())) == [(0, "train"), (0, "validation"), (1, "train")]


def test_broken_comparisons_fail(spark, failing):
    assert "choice must be 0 or 1, got NULL" in failing(rec.pick_chosen_rejected(frame(spark, record(choice=None))))
    one = record()
    one["summaries"] = one["summaries"][:1]
    assert "two summaries" in failing(rec.pick_chosen_rejected(frame(spark, one)))


def test_bad_lines_fail_whatever_is_read(spark, tmp_path, failing):
    (tmp_path / "bad.json").write_text('{"choice": 1, "worker": "a"}\n\n{"choice": "abc", "worker": "b"}\n')
    df = feedback.read_comparisons(spark, str(tmp_path))
    failing(df.select("worker"))
    with pytest.raises(Exception):
        df.count()
