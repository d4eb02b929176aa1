import json

import pytest
from pyspark.sql import functions as F

from prefloom.plans.evaluation import rollout_validation, sft_eval
from prefloom.plans.scoring import score_and_centre
from prefloom.schemas import SftParams
from prefloom.sources.published import publish, published, read_published
from prefloom.sources.tables import versioned_path


def rows(spark, n):
    split = F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "validation")
    return spark.range(n).select("id", split.alias("split"), F.col("id").cast("string").alias("text"))


def test_a_version_is_read_when_it_is_whole(spark, tmp_path):
    base = str(tmp_path / "set")
    with pytest.raises(LookupError, match="no version"):
        read_published(spark, base)
    publish(rows(spark, 10), base, "20240101_000000", SftParams(), "here")
    publish(rows(spark, 20), base, "20240201_000000", {"a": 1}, "there")
    assert read_published(spark, base).count() == 20 and read_published(spark, base, "20240101_000000").count() == 10
    assert {r.id for r in read_published(spark, base, split="train").collect()} == {0, 3, 6, 9, 12, 15, 18}
    assert read_published(spark, base).where("split IS NULL").count() == 6
    log = {r.version: r for r in published(spark, base).collect()}
    assert {s.split: s.n_rows for s in log["20240201_000000"].splits} == {None: 6, "train": 7, "validation": 7}
    assert json.loads(log["20240101_000000"].params)["budget"] == 512
    with pytest.raises(ValueError, match="published already"):
        publish(rows(spark, 1), base, "20240201_000000", {}, "again")


def test_a_killed_write_leaves_no_version(spark, tmp_path):
    base = str(tmp_path / "set")
    publish(rows(spark, 4), base, "1", {}, "here")
    half = rows(spark, 40).withColumn("text", F.when(F.col("id") == 37, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        publish(half, base, "2", {}, "here")
    # Files of an attempt that died between writing and logging are no version either, and the next attempt replaces them.
    rows(spark, 99).write.mode("overwrite").partitionBy("split").parquet(versioned_path(base, "2"))
    assert read_published(spark, base).count() == 4
    with pytest.raises(LookupError, match="not published"):
        read_published(spark, base, "2")
    publish(rows(spark, 7), base, "2", {}, "here")
    assert read_published(spark, base).count() == 7


def test_the_frame_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touch(x):
        seen.add(1)
        return x

    publish(rows(spark, 50).withColumn("text", touch("text")), str(tmp_path / "set"), "1", {}, "here")
    assert seen.value == 50


def test_an_empty_version(spark, tmp_path):
    publish(rows(spark, 0), str(tmp_path / "set"), "1", {}, "here")
    assert read_published(spark, str(tmp_path / "set")).count() == 0


def test_supervised_evaluation(spark):
    data = [(1, [-9.0, -1.0, -2.0], [5, 6, -100]), (2, [-9.0, -3.0, -5.0], [5, 6, 7]), (3, [-9.0, -4.0], [5, -100]), (4, [], [])]
    logged = spark.createDataFrame(data, "id long, log_probs array<double>, labels array<long>")
    # Batches of one: 1, 4, none, none; of two: (1 + 3 + 5) / 3, none.
    assert tuple(sft_eval(logged, "id", 1).first()) == (2.5, 2, 2)
    assert tuple(sft_eval(logged, "id", 2).first()) == (3.0, 1, 1)
    assert tuple(sft_eval(logged.where("false"), "id", 2).first()) == (None, 0, 0)


def test_rollout_validation(spark, tmp_path):
    data = [(1, "one", [7, 1, 0], [0.5, 0.5, 0.5]), (1, "two", [7, 7, 7], [0.5, 0.5, 0.5]), (2, None, [7, 1, 0], [0.25, 0.25, 0.25])]
    rollouts = spark.createDataFrame(data, "step long, said string, response_tokens array<long>, token_scores array<double>")
    means = rollout_validation(rollouts, F.col("said"), str(tmp_path / "report"), pad_id=0, eos_id=1)
    assert {r.step: (r.mean_reward, r.n) for r in means.collect()} == {1: (-0.25, 2), 2: (0.25, 1)}
    lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "step=1")).collect()]
    assert sorted(lines) == sorted(["Reward: 0.5000", "one", "=" * 100, "Reward: -1.0000", "two", "=" * 100])


def test_scores_are_stored_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def score(batch):
            seen.add(len(batch))
            return batch.map(len).astype("float64")

        return score

    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3, 4])], "id long, tokens array<long>")
    out = score_and_centre(df, "tokens", make, str(tmp_path / "t"))
    assert {r.id: (r.score, r.centred_score) for r in out.collect()} == {1: (2.0, -1.0), 2: (4.0, 1.0)}
    assert spark.read.parquet(str(tmp_path / "t_with_rewards")).count() == 2 == seen.value
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        score_and_centre(df, "tokens", make, str(tmp_path / "t"))
