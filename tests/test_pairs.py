import math

import pytest
from pyspark.sql import functions as F

from prefloom.operators import batch_means as bm
from prefloom.operators import pairs as pr
from prefloom.plans.evaluation import dpo_eval, reward_eval


def scored(spark, n=17):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pair_id int, chosen double, rejected double")


def test_stack_and_unstack(spark):
    rows, df = scored(spark)
    stacked = pr.stack_pairs(df, ["pair_id"], score=("chosen", "rejected"))
    assert stacked.count() == 34
    back = pr.unstack_pairs(stacked.repartition(5), ["pair_id"], "score")
    assert sorted(map(tuple, back.collect())) == rows


def test_ties_count_as_wrong(spark):
    rows, df = scored(spark)
    want = sum(c > r for _, c, r in rows) / len(rows)
    assert pr.pair_accuracy(df).first().accuracy == pytest.approx(want)


def test_short_last_batch_weighs_as_much(spark):
    rows, df = scored(spark)
    losses = [math.log1p(math.exp(-(c - r))) for _, c, r in rows]
    batches = [losses[:8], losses[8:16], losses[16:]]
    report = reward_eval(df, "pair_id", 8).first()
    assert report.batches == 3
    assert report.eval_loss == pytest.approx(sum(sum(b) / len(b) for b in batches) / 3)
    assert report.eval_loss != pytest.approx(sum(losses) / 17)


def test_dpo_eval(spark):
    df = spark.createDataFrame([(0, 2.0, 1.0, 0.0, 0.5), (1, 0.0, 0.0, 0.0, 0.0)], "pair_id int, policy_chosen double, ref_chosen double, policy_rejected double, ref_rejected double")
    report = dpo_eval(df, "pair_id", 2, beta=0.5).first()
    assert report.eval_accuracy == 0.5
    assert report.eval_loss == pytest.approx((math.log1p(math.exp(-0.75)) + math.log(2)) / 2)


def test_alignment_by_key(spark, failing):
    def logs(*sides):
        return [
            spark.createDataFrame([(i, [float(i + 10 * n)]) for i in ids], "k int, log_probs array<double>")
            for n, ids in enumerate(sides)
        ]

    rows = pr.align_policy_reference(*logs((1, 2), (2, 1), (2, 1, 3)), "k").collect()
    assert sorted(tuple(r) for r in rows) == [(1, [1.0], [11.0], [21.0]), (2, [2.0], [12.0], [22.0])]
    assert "no ref_log_probs for sequence 1" in failing(pr.align_policy_reference(*logs((1, 2), (2, 1), (2,)), "k"))


def test_accumulation_drops_the_tail_unless_told(spark):
    df = spark.range(35).withColumn("loss", F.lit(2.0))
    steps = bm.accumulated_steps(df, "id", ["loss"], 16).orderBy("step").collect()
    assert [(r.step, r.loss) for r in steps] == [(0, 2.0), (1, 2.0)]
    tail = bm.accumulated_steps(df, "id", ["loss"], 16, keep_tail=True).where("step = 2").first()
    assert tail.micro_batches == 3 and tail.loss == pytest.approx(6 / 16)


def test_update_budget(spark):
    df = spark.range(100).withColumn("split", F.lit("train"))
    row = bm.update_budget(df, batch_size=8, accumulation=4, epochs=2, warmup_ratio=0.3).first()
    assert (row.n_rows, row.batches, row.updates_per_epoch, row.total_updates, row.warmup_steps) == (100, 13, 4, 8, 1)


def test_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "step int, score double")
    assert tuple(bm.mean_score(df).first()) == (3.0, 3)
    assert {tuple(r) for r in bm.rollout_mean_reward(df, F.col("score")).collect()} == {(0, 2.0, 2), (1, 5.0, 1)}
