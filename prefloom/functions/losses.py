"""Loss, ratio and KL arithmetic on logged scores and log-probabilities.

Scalar functions work on plain columns as well as inside a lambda over tokens. The array
functions fold a sequence in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.sequences import let

# Clamps and defaults of the published training runs.
RATIO_CLAMP = 20.0
KL_CLAMP = 10.0
MEAN_EPSILON = 1e-7
CLIP = 0.2
DUAL_CLIP = 3.0
KL_COEFF = 0.05
KL_MODES = ("k1", "k2", "k3")
LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean")


def _clamp(x: Column, bound: float) -> Column:
    return F.least(F.greatest(x, F.lit(-bound)), F.lit(bound))


def neg_log_sigmoid(x: Column) -> Column:
    """``-log(sigmoid(x))``, stable on both sides."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_loss(chosen: Column, rejected: Column) -> Column:
    return neg_log_sigmoid(chosen - rejected)


def dpo_margin(policy_chosen: Column, ref_chosen: Column, policy_rejected: Column, ref_rejected: Column) -> Column:
    return (policy_chosen - ref_chosen) - (policy_rejected - ref_rejected)


def dpo_loss(margin: Column, beta: float, label_smoothing: float = 0.0) -> Column:
    scaled = F.lit(beta) * margin
    loss = F.lit(1.0 - label_smoothing) * neg_log_sigmoid(scaled)
    return loss + F.lit(label_smoothing) * neg_log_sigmoid(-scaled) if label_smoothing else loss


def log_softmax_at(scores: Column, index: Column, temperature: float = 1.0) -> Column:
    """Temperature-scaled log-softmax of ``scores`` at a 0-based index."""

    def at(peak: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp((x - peak) / F.lit(temperature)))
        return (F.get(scores, index) - peak) / F.lit(temperature) - F.log(total)

    return let(F.array_max(scores), at)


def clamped_ratio(new: Column, old: Column) -> Column:
    return F.exp(_clamp(new - old, RATIO_CLAMP))


def clipped_surrogate(ratio: Column, advantage: Column, clip: float = CLIP, dual_clip: float = DUAL_CLIP) -> Column:
    """Per-token policy loss: ratio clipping, plus a second bound where the advantage is negative."""
    bounded = F.least(F.greatest(ratio, F.lit(1.0 - clip)), F.lit(1.0 + clip))
    loss = F.greatest(-advantage * ratio, -advantage * bounded)
    return F.when(advantage < 0, F.least(loss, -advantage * F.lit(dual_clip))).otherwise(loss)


def kl_penalty(log_prob: Column, ref_log_prob: Column, mode: str = "k3") -> Column:
    diff = log_prob - ref_log_prob
    if mode == "k1":
        return diff
    if mode == "k2":
        return F.lit(0.5) * diff * diff
    if mode == "k3":
        diff = _clamp(diff, RATIO_CLAMP)
        return _clamp(F.exp(diff) - diff - F.lit(1.0), KL_CLAMP)
    raise ValueError(f"Invalid KL penalty mode: {mode}")


def grpo_loss(policy_loss: Column, kl_loss: Column, kl_coeff: float = KL_COEFF) -> Column:
    return policy_loss + F.lit(kl_coeff) * kl_loss


def _mask_count(mask: Column) -> Column:
    return F.array_size(F.filter(mask, lambda m: m)).cast("double")


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of the values where the mask is true."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    return F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)


def masked_mean(values: Column, mask: Column) -> Column:
    """Masked mean of one sequence, safe for an all-false mask."""
    return masked_sum(values, mask) / (_mask_count(mask) + F.lit(MEAN_EPSILON))


def sequence_logp(log_probs: Column, mask: Column) -> Column:
    return masked_sum(log_probs, mask)


def check_loss_mode(mode: str) -> str:
    if mode not in LOSS_MODES:
        raise ValueError(f"Invalid loss aggregation mode: {mode}")
    return mode
