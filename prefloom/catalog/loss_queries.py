"""Loss arithmetic and its aggregates over logged scores and token log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.registry import query
from prefloom.catalog.views import rounded, sql_round, with_views
from prefloom.functions import losses as ls
from prefloom.functions.sequences import terminal_score
from prefloom.operators import batch_means as bm
from prefloom.operators import pairs as pr
from prefloom.operators import token_losses as tl
from prefloom.operators.ordering import assign_batches
from prefloom.plans.evaluation import dpo_eval, reward_eval
from prefloom.plans.rollouts import policy_loss_report


def sql_nls(x: str) -> str:
    """-log(sigmoid(x))."""
    return f"(greatest(-({x}), 0.0) + ln(1 + exp(-abs({x}))))"


MARGIN = "(policy_chosen - ref_chosen) - (policy_rejected - ref_rejected)"
RATIO = "exp(least(greatest(lp - old, -20.0), 20.0))"
SURROGATE = (
    f"CASE WHEN advantage < 0 THEN least(greatest(-advantage * {RATIO}, -advantage * least(greatest({RATIO}, 0.8), 1.2)), -advantage * 3.0) "
    f"ELSE greatest(-advantage * {RATIO}, -advantage * least(greatest({RATIO}, 0.8), 1.2)) END"
)
K3_DIFF = "least(greatest(lp - ref, -20.0), 20.0)"
K3 = f"least(greatest(exp({K3_DIFF}) - {K3_DIFF} - 1, -10.0), 10.0)"


def aligned(spark, d):
    return pr.align_policy_reference(v.token_log(spark, d), v.old_log(spark, d), v.reference_log(spark, d), "vec_id")


def tokens(spark, d):
    arrays = {"lp": "policy_log_probs", "old": "old_log_probs", "ref": "ref_log_probs"}
    return tl.token_rows(aligned(spark, d), "mask", arrays, keep=["vec_id", "advantage"])


def wide_pairs(spark, d):
    """(pair_id, policy_chosen, ref_chosen, policy_rejected, ref_rejected)."""
    sides = v.pair_sides(spark, d).withColumnsRenamed({"policy_logp": "policy", "ref_logp": "ref"})
    return pr.unstack_pairs(sides, ["pair_id"], "policy", "ref")


@query("pair_loss", with_views(f" SELECT pair_id, {sql_round(sql_nls('chosen - rejected'))} AS loss FROM v_pairs", "v_pairs"))
def pair_loss_query(spark, d):
    return v.pairs(spark, d).select("pair_id", rounded(ls.pair_loss(F.col("chosen"), F.col("rejected"))).alias("loss"))


@query("dpo_margin", with_views(f" SELECT pair_id, {sql_round(MARGIN)} AS margin FROM v_pairs", "v_pairs"))
def dpo_margin_query(spark, d):
    margin = ls.dpo_margin(*[F.col(c) for c in ("policy_chosen", "ref_chosen", "policy_rejected", "ref_rejected")])
    return wide_pairs(spark, d).select("pair_id", rounded(margin).alias("margin"))


@query(
    "dpo_loss",
    with_views(
        f", m AS (SELECT pair_id, {MARGIN} AS z FROM v_pairs) "
        f"SELECT pair_id, {sql_round(sql_nls('0.1 * z'))} AS loss, "
        f"{sql_round('0.9 * ' + sql_nls('0.1 * z') + ' + 0.1 * ' + sql_nls('-0.1 * z'))} AS smoothed_loss FROM m",
        "v_pairs",
    ),
)
def dpo_loss_query(spark, d):
    plain = pr.dpo_pair_metrics(wide_pairs(spark, d), beta=0.1)
    smoothed = ls.dpo_loss(F.col("margin"), 0.1, 0.1)
    return plain.select("pair_id", rounded("loss").alias("loss"), rounded(smoothed).alias("smoothed_loss"))


@query(
    "log_softmax_at",
    with_views(
        f" SELECT vec_id, {sql_round('scores[label + 1] / 0.7 - ln((SELECT sum(exp(x / 0.7)) FROM (SELECT unnest(scores) AS x)))')} AS log_prob FROM v_scores_at",
        "v_scores_at",
    ),
)
def log_softmax_at_query(spark, d):
    value = ls.log_softmax_at(F.col("scores"), F.col("label"), 0.7)
    return v.scores_at(spark, d).select("vec_id", rounded(value).alias("log_prob"))


@query("clamped_ratio", with_views(f" SELECT vec_id, pos, {sql_round(RATIO)} AS ratio FROM v_tokens", "v_tokens"))
def clamped_ratio_query(spark, d):
    ratio = ls.clamped_ratio(F.col("lp"), F.col("old"))
    return tokens(spark, d).select("vec_id", F.col("_pos").cast("bigint").alias("pos"), rounded(ratio).alias("ratio"))


@query("clipped_surrogate", with_views(f" SELECT vec_id, pos, {sql_round(SURROGATE)} AS loss FROM v_tokens", "v_tokens"))
def clipped_surrogate_query(spark, d):
    loss = ls.clipped_surrogate(ls.clamped_ratio(F.col("lp"), F.col("old")), F.col("advantage"))
    return tokens(spark, d).select("vec_id", F.col("_pos").cast("bigint").alias("pos"), rounded(loss).alias("loss"))


@query(
    "kl_penalty",
    with_views(
        f" SELECT vec_id, pos, {sql_round('lp - ref')} AS k1, {sql_round('0.5 * (lp - ref) * (lp - ref)')} AS k2, {sql_round(K3)} AS k3 FROM v_tokens",
        "v_tokens",
    ),
)
def kl_penalty_query(spark, d):
    terms = [rounded(ls.kl_penalty(F.col("lp"), F.col("ref"), mode)).alias(mode) for mode in ls.KL_MODES]
    return tokens(spark, d).select("vec_id", F.col("_pos").cast("bigint").alias("pos"), *terms)


PER_SEQUENCE = (
    f", s AS (SELECT vec_id, any_value(label) AS label, sum(CASE WHEN m THEN {SURROGATE} ELSE 0 END) AS pg, "
    f"sum(CASE WHEN m THEN {K3} ELSE 0 END) AS kl, sum(m::INT) AS n FROM v_tokens GROUP BY vec_id)"
)


def sql_mode(value: str, mode: str) -> str:
    if mode == "token-mean":
        return f"sum({value}) / sum(n)"
    if mode == "seq-mean-token-sum":
        return f"avg({value}) FILTER (WHERE n > 0)"
    return f"avg({value} / (n + 1e-7)) FILTER (WHERE n > 0)"


@query(
    "grpo_loss",
    with_views(
        f"{PER_SEQUENCE} "
        + " UNION ALL ".join(
            f"SELECT '{m}' AS mode, {sql_round(sql_mode('pg', m) + ' + 0.05 * ' + sql_mode('kl', m))} AS loss FROM s" for m in ls.LOSS_MODES
        ),
        "v_tokens",
    ),
)
def grpo_loss_query(spark, d):
    rows = tokens(spark, d)
    surrogate = ls.clipped_surrogate(ls.clamped_ratio(F.col("lp"), F.col("old")), F.col("advantage"))
    penalty = ls.kl_penalty(F.col("lp"), F.col("ref"), "k3")
    both = tl.losses_by_mode(rows, {"policy": surrogate, "kl": penalty})
    return both.select("mode", rounded(ls.grpo_loss(F.col("policy"), F.col("kl"))).alias("loss"))


@query(
    "policy_loss_report",
    with_views(
        f"{PER_SEQUENCE} SELECT label, {sql_round(sql_mode('pg', 'seq-mean-token-mean'))} AS policy_loss, "
        f"{sql_round(sql_mode('kl', 'seq-mean-token-mean'))} AS kl_loss, "
        f"{sql_round(sql_mode('pg', 'seq-mean-token-mean') + ' + 0.05 * ' + sql_mode('kl', 'seq-mean-token-mean'))} AS grpo_loss FROM s GROUP BY label",
        "v_tokens",
    ),
)
def policy_loss_report_query(spark, d):
    report = policy_loss_report(aligned(spark, d), by=["label"])
    return report.select("label", *[rounded(c).alias(c) for c in ("policy_loss", "kl_loss", "grpo_loss")])


@query(
    "masked_mean",
    with_views(
        f" SELECT vec_id, {sql_round('sum(CASE WHEN m THEN lp ELSE 0 END) / (sum(m::INT) + 1e-7)')} AS masked_mean FROM v_tokens GROUP BY vec_id "
        f"UNION ALL SELECT -1, {sql_round('sum(CASE WHEN m THEN lp ELSE 0 END) / (sum(m::INT) + 1e-7)')} FROM v_tokens",
        "v_tokens",
    ),
)
def masked_mean_query(spark, d):
    rows = aligned(spark, d)
    each = rows.select("vec_id", rounded(ls.masked_mean(F.col("policy_log_probs"), F.col("mask"))).alias("masked_mean"))
    overall = tl.masked_mean_over(rows, "policy_log_probs", "mask")
    return each.unionByName(overall.select(F.lit(-1).cast("bigint").alias("vec_id"), rounded("masked_mean").alias("masked_mean")))


@query(
    "agg_losses",
    with_views(
        ", s AS (SELECT vec_id, sum(CASE WHEN m THEN lp ELSE 0 END) AS x, sum(m::INT) AS n FROM v_tokens GROUP BY vec_id) "
        + " UNION ALL ".join(f"SELECT '{m}' AS mode, {sql_round(sql_mode('x', m))} AS loss FROM s" for m in ls.LOSS_MODES),
        "v_tokens",
    ),
)
def agg_losses_query(spark, d):
    return tl.agg_losses(aligned(spark, d), "policy_log_probs", "mask").select("mode", rounded("loss").alias("loss"))


@query(
    "sequence_logp",
    with_views(f" SELECT vec_id, {sql_round('sum(CASE WHEN m THEN lp ELSE 0 END)')} AS logp FROM v_tokens GROUP BY vec_id", "v_tokens"),
)
def sequence_logp_query(spark, d):
    return aligned(spark, d).select("vec_id", rounded(ls.sequence_logp(F.col("policy_log_probs"), F.col("mask"))).alias("logp"))


@query(
    "token_cross_entropy",
    with_views(
        f" SELECT label AS batch_id, {sql_round('-avg(lp)')} AS cross_entropy, count(*) AS n_tokens FROM v_tokens WHERE m GROUP BY label",
        "v_tokens",
    ),
)
def token_cross_entropy_query(spark, d):
    labels = F.transform("mask", lambda m: F.when(m, F.lit(5)).otherwise(F.lit(-100)).cast("bigint"))
    rows = aligned(spark, d).select(F.col("label").alias("batch_id"), "policy_log_probs", labels.alias("labels"))
    out = tl.token_cross_entropy(rows, "policy_log_probs", "labels")
    return out.withColumn("cross_entropy", rounded("cross_entropy"))


@query(
    "pair_accuracy",
    with_views(
        f" SELECT {sql_round('avg((chosen > rejected)::INT)')} AS reward_accuracy, {sql_round(f'avg(({MARGIN} > 0)::INT)')} AS dpo_accuracy FROM v_pairs",
        "v_pairs",
    ),
)
def pair_accuracy_query(spark, d):
    reward = pr.pair_accuracy(v.pairs(spark, d)).scalar()
    dpo = pr.dpo_pair_metrics(wide_pairs(spark, d), beta=0.1)
    return dpo.agg(rounded(F.max(reward)).alias("reward_accuracy"), rounded(F.avg("correct")).alias("dpo_accuracy"))


def sql_batched_eval(loss: str, correct: str) -> str:
    return with_views(
        f", b AS (SELECT (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id, {loss} AS loss, ({correct})::INT AS correct FROM v_pairs), "
        "m AS (SELECT batch_id, avg(loss) AS loss, avg(correct) AS correct FROM b GROUP BY batch_id) "
        f"SELECT {sql_round('avg(loss)')} AS eval_loss, {sql_round('avg(correct)')} AS eval_accuracy, count(*) AS batches FROM m",
        "v_pairs",
    )


@query("mean_of_batch_means", sql_batched_eval(sql_nls("chosen - rejected"), "chosen > rejected").replace("eval_", ""))
def mean_of_batch_means_query(spark, d):
    scored = pr.reward_pair_metrics(v.pairs(spark, d))
    batched = assign_batches(scored, 16, "pair_id").withColumnRenamed("correct", "accuracy")
    means = bm.mean_of_batch_means(batched, ["loss", "accuracy"])
    return means.select(rounded("loss").alias("loss"), rounded("accuracy").alias("accuracy"), "batches")


def _rounded_eval(report):
    return report.select(rounded("eval_loss").alias("eval_loss"), rounded("eval_accuracy").alias("eval_accuracy"), "batches")


@query("preference_eval_reward", sql_batched_eval(sql_nls("chosen - rejected"), "chosen > rejected"))
def reward_eval_query(spark, d):
    return _rounded_eval(reward_eval(v.pairs(spark, d), "pair_id", 16))


@query("preference_eval_dpo", sql_batched_eval(sql_nls(f"0.1 * ({MARGIN})"), f"{MARGIN} > 0"))
def dpo_eval_query(spark, d):
    return _rounded_eval(dpo_eval(wide_pairs(spark, d), "pair_id", 16, beta=0.1))


@query("mean_score", f"SELECT {sql_round('avg(value)')} AS mean_score, count(*) AS n FROM events")
def mean_score_query(spark, d):
    return bm.mean_score(v.table(spark, d, "events"), "value").withColumn("mean_score", rounded("mean_score"))


@query(
    "accumulated_steps",
    f"SELECT event_id // 16 AS step, count(*) AS micro_batches, {sql_round('sum(value) / 16')} AS value FROM events GROUP BY 1 HAVING count(*) = 16",
)
def accumulated_steps_query(spark, d):
    return bm.accumulated_steps(v.table(spark, d, "events"), "event_id", ["value"], 16).withColumn("value", rounded("value"))


@query(
    "rollout_mean_reward",
    with_views(f" SELECT prompt_id // 16 AS step, {sql_round('avg(reward)')} AS mean_reward, count(*) AS n FROM v_rollouts GROUP BY 1", "v_rollouts"),
)
def rollout_mean_reward_query(spark, d):
    rows = v.rollouts(spark, d).withColumn("step", F.expr("prompt_id div 16"))
    reward = terminal_score(F.col("token_scores"), F.col("response_tokens"), 0, 1)
    return bm.rollout_mean_reward(rows, reward).withColumn("mean_reward", rounded("mean_reward"))


@query(
    "update_budget",
    """SELECT event_type AS split, count(*) AS n_rows, ceil(count(*) / 8.0)::BIGINT AS batches,
        ceil(ceil(count(*) / 8.0) / 16)::BIGINT AS updates_per_epoch, (ceil(ceil(count(*) / 8.0) / 16) * 3)::BIGINT AS total_updates,
        floor(ceil(ceil(count(*) / 8.0) / 16) * 0.1)::BIGINT AS warmup_steps FROM events GROUP BY event_type""",
)
def update_budget_query(spark, d):
    rows = v.table(spark, d, "events").withColumnRenamed("event_type", "split")
    return bm.update_budget(rows, batch_size=8, accumulation=16, epochs=3, warmup_ratio=0.1)
