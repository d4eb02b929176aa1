import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions import losses as ls
from prefloom.operators import token_losses as tl
from prefloom.plans.rollouts import policy_loss_report


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("d", [-800.0, -50.0, -1.0, 0.0, 3.0, 800.0])
def test_pair_loss_is_stable(spark, d):
    expected = np.logaddexp(0, -d)
    assert one(spark, ls.pair_loss(F.col("c"), F.col("r")), c=d, r=0.0) == pytest.approx(expected, abs=1e-12)


def test_dpo_loss_with_smoothing(spark):
    z, beta, s = 1.7, 0.3, 0.1
    expected = (1 - s) * np.logaddexp(0, -beta * z) + s * np.logaddexp(0, beta * z)
    assert one(spark, ls.dpo_loss(F.col("z"), beta, s), z=z) == pytest.approx(expected)


def test_log_softmax_at(spark):
    scores, t = [1000.0, 999.0, -5.0], 0.7
    x = np.array(scores) / t
    expected = x - np.logaddexp.reduce(x)
    for i in range(3):
        assert one(spark, ls.log_softmax_at(F.col("s"), F.col("i"), t), s=scores, i=i) == pytest.approx(expected[i])


@pytest.mark.parametrize("diff", [-50.0, 50.0, 0.3])
def test_clamps(spark, diff):
    ratio = one(spark, ls.clamped_ratio(F.col("a"), F.col("b")), a=diff, b=0.0)
    assert ratio == pytest.approx(math.exp(max(min(diff, 20), -20)))
    k3 = one(spark, ls.kl_penalty(F.col("a"), F.col("b"), "k3"), a=diff, b=0.0)
    c = max(min(diff, 20), -20)
    assert k3 == pytest.approx(max(min(math.exp(c) - c - 1, 10), -10))
    assert one(spark, ls.kl_penalty(F.col("a"), F.col("b"), "k2"), a=diff, b=0.0) == pytest.approx(diff * diff / 2)


def test_dual_clip_bounds_negative_advantages(spark):
    loss = ls.clipped_surrogate(F.col("r"), F.col("a"))
    assert one(spark, loss, r=5.0, a=-2.0) == pytest.approx(6.0)
    assert one(spark, loss, r=2.0, a=-2.0) == pytest.approx(4.0)
    assert one(spark, loss, r=5.0, a=2.0) == pytest.approx(-2.4)
    assert one(spark, loss, r=0.5, a=2.0) == pytest.approx(-1.0)


def test_unknown_modes_fail_before_a_query_runs():
    with pytest.raises(ValueError, match="KL penalty"):
        ls.kl_penalty(F.col("a"), F.col("b"), "k4")
    with pytest.raises(ValueError, match="aggregation"):
        ls.check_loss_mode("mean")


def sequences(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 9))
        mask = [bool(b) for b in rng.random(n) < (0.0 if i % 10 == 0 else 0.7)]
        rows.append((i, *[[float(v) for v in rng.normal(size=n)] for _ in range(3)], mask, float(rng.normal())))
    schema = (
        "id int, policy_log_probs array<double>, old_log_probs array<double>, ref_log_probs array<double>, "
        "mask array<boolean>, advantage double"
    )
    return rows, spark.createDataFrame(rows, schema)


def expected_loss(rows, mode, token_loss):
    sums, counts = [], []
    for row in rows:
        mask = np.array(row[4], dtype=float)
        sums.append((np.array(token_loss(row)) * mask).sum())
        counts.append(mask.sum())
    sums, counts = np.array(sums), np.array(counts)
    if mode == "token-mean":
        return sums.sum() / counts.sum()
    per_sequence = sums if mode == "seq-mean-token-sum" else sums / (counts + 1e-7)
    return per_sequence[counts > 0].mean()


def surrogate(row):
    ratio = np.exp(np.clip(np.array(row[1]) - np.array(row[2]), -20, 20))
    loss = np.maximum(-row[5] * ratio, -row[5] * np.clip(ratio, 0.8, 1.2))
    return np.minimum(loss, -row[5] * 3.0) if row[5] < 0 else loss


def k3(row):
    d = np.clip(np.array(row[1]) - np.array(row[3]), -20, 20)
    return np.clip(np.exp(d) - d - 1, -10, 10)


@pytest.mark.parametrize("mode", ls.LOSS_MODES)
def test_policy_loss_report(spark, mode):
    rows, df = sequences(spark)
    report = policy_loss_report(df.repartition(3), mode=mode).first()
    policy, kl = expected_loss(rows, mode, surrogate), expected_loss(rows, mode, k3)
    assert (report.policy_loss, report.kl_loss) == pytest.approx((policy, kl))
    assert report.grpo_loss == pytest.approx(policy + 0.05 * kl)


def test_report_needs_no_token_shuffle(spark):
    _, df = sequences(spark)
    plan = policy_loss_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan and "hashpartitioning" not in plan


def test_agg_losses_and_masked_means(spark):
    rows, df = sequences(spark)
    got = {r.mode: r.loss for r in tl.agg_losses(df, "policy_log_probs", "mask").collect()}
    for mode in ls.LOSS_MODES:
        assert got[mode] == pytest.approx(expected_loss(rows, mode, lambda row: row[1]))
    overall = tl.masked_mean_over(df, "policy_log_probs", "mask").first().masked_mean
    assert overall == pytest.approx(expected_loss(rows, "token-mean", lambda row: row[1]))
    each = df.select("id", ls.masked_mean(F.col("policy_log_probs"), F.col("mask")).alias("m")).collect()
    assert {r.id: r.m for r in each}[0] == 0.0


def test_cross_entropy_skips_ignored_labels(spark):
    df = spark.createDataFrame([(0, [-1.0, -2.0, -3.0], [-100, 4, 5]), (0, [-5.0], [3]), (1, [-1.0], [-100])], "batch_id int, lp array<double>, labels array<bigint>")
    rows = tl.token_cross_entropy(df, "lp", "labels").collect()
    assert [(r.batch_id, r.cross_entropy, r.n_tokens) for r in rows] == [(0, pytest.approx(10 / 3), 3)]
