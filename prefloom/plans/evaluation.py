"""Evaluation reports over logged pairs, sequences and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.sequences import terminal_reward
from prefloom.operators.batch_means import mean_of_batch_means, rollout_mean_reward
from prefloom.operators.ordering import assign_batches
from prefloom.operators.pairs import dpo_pair_metrics, reward_pair_metrics
from prefloom.operators.token_losses import token_cross_entropy
from prefloom.session import cut_lineage
from prefloom.sources.tables import write_text_report


def _report(pairs: DataFrame, key: str, batch_size: int) -> DataFrame:
    batched = assign_batches(pairs.select(key, "loss", "correct"), batch_size, key)
    out = mean_of_batch_means(batched, ["loss", "correct"])
    return out.select(F.col("loss").alias("eval_loss"), F.col("correct").alias("eval_accuracy"), "batches")


def reward_eval(pairs: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Loss and accuracy of a reward model over batches of (key, chosen, rejected) scores."""
    return _report(reward_pair_metrics(pairs), key, batch_size)


def dpo_eval(pairs: DataFrame, key: str, batch_size: int, beta: float, label_smoothing: float = 0.0) -> DataFrame:
    """Loss and accuracy of policy against reference over batches of (key, policy_chosen,
    ref_chosen, policy_rejected, ref_rejected) log-probabilities."""
    return _report(dpo_pair_metrics(pairs, beta, label_smoothing), key, batch_size)


def sft_eval(logged: DataFrame, key: str, batch_size: int, log_probs: str = "log_probs", labels: str = "labels") -> DataFrame:
    """One row (eval_loss, batches, unlabelled): the supervised evaluation loss over batches in the order of ``key``.

    ``log_probs[t]`` is what the model gave token t after those before it, so the first place of either array
    predicts nothing and is left out. A batch's loss is the mean over its labels that are not ignored, the report
    the plain mean of those. Batches without such a label have no loss; they are counted as ``unlabelled``.
    """
    rows = assign_batches(logged.select(key, log_probs, labels), batch_size, key)
    cut = {c: F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))) for c in (log_probs, labels)}
    per_batch = token_cross_entropy(rows.withColumns(cut), log_probs, labels)
    batches = rows.agg(F.count_distinct("batch_id").alias("n")).scalar()
    out = per_batch.agg(F.avg("cross_entropy").alias("eval_loss"), F.count("*").alias("batches"))
    return out.withColumn("unlabelled", F.coalesce(batches, F.lit(0)) - F.col("batches"))


def rollout_validation(
    rollouts: DataFrame, text: Column, report: str, pad_id: int, eos_id: int, step: str = "step"
) -> DataFrame:
    """Rows (step, mean_reward, n) of validation rollouts (step, response_tokens, token_scores, and what ``text`` reads),
    whose texts and rewards are appended to ``report``, a folder for each step.

    A rollout's reward is the sum of its token rewards. Rewards and decoded texts are written to the shared
    folder once, and the report and the means read them from there.
    """
    rewards = terminal_reward(F.col("token_scores"), F.col("response_tokens"), pad_id, eos_id)
    total = F.aggregate(rewards, F.lit(0.0), lambda s, x: s + x)
    scored = cut_lineage(rollouts.select(F.col(step), total.alias("reward"), F.coalesce(text, F.lit("")).alias("text")))
    write_text_report(scored, report, step, "reward", "text")
    return rollout_mean_reward(scored, F.col("reward"), by=(step,))
