"""Audit of logged rollouts: rewards, advantages and policy losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.losses import CLIP, DUAL_CLIP, KL_COEFF, clamped_ratio, clipped_surrogate, grpo_loss, kl_penalty
from prefloom.functions.sequences import attention_mask, terminal_score
from prefloom.operators.groups import broadcast_advantage, group_advantage
from prefloom.operators.token_losses import reduce_losses, token_rows


def audit_rollouts(
    rollouts: DataFrame,
    pad_id: int,
    eos_id: int,
    group: str = "prompt_id",
    group_size: int | None = None,
    no_eos_penalty: float = -1.0,
    normalize: bool = True,
) -> DataFrame:
    """Per response: its summed token reward, whether it was empty, and its advantage on each
    response token. ``token_scores`` and ``response_tokens`` are parallel arrays."""
    reward = terminal_score(F.col("token_scores"), F.col("response_tokens"), pad_id, eos_id, no_eos_penalty)
    scored = rollouts.withColumn("score", reward).withColumn(
        "empty_response", ~F.exists("response_tokens", lambda t: t != pad_id)
    )
    advantaged = group_advantage(scored, group, "score", normalize, group_size)
    masked = advantaged.withColumn("response_mask", attention_mask(F.col("response_tokens"), pad_id))
    return broadcast_advantage(masked, "response_mask")


def policy_loss_report(
    sequences: DataFrame,
    by: Sequence[str] = (),
    mode: str = "seq-mean-token-mean",
    kl_mode: str = "k3",
    kl_coeff: float = KL_COEFF,
    clip: float = CLIP,
    dual_clip: float = DUAL_CLIP,
) -> DataFrame:
    """Policy loss, KL loss and their weighted sum, over all sequences or per ``by`` group.

    ``sequences`` holds the parallel arrays ``policy_log_probs``, ``old_log_probs``,
    ``ref_log_probs``, a boolean ``mask`` and one ``advantage`` per sequence.
    """
    arrays = {"new": "policy_log_probs", "old": "old_log_probs", "ref": "ref_log_probs"}
    tokens = token_rows(sequences, "mask", arrays, keep=[*by, "advantage"])
    ratio = clamped_ratio(F.col("new"), F.col("old"))
    losses = {
        "policy_loss": clipped_surrogate(ratio, F.col("advantage"), clip, dual_clip),
        "kl_loss": kl_penalty(F.col("new"), F.col("ref"), kl_mode),
    }
    report = reduce_losses(tokens, losses, mode, by)
    return report.withColumn("grpo_loss", grpo_loss(F.col("policy_loss"), F.col("kl_loss"), kl_coeff))
