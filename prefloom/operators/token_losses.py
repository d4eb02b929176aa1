"""Losses of tokens reduced over sequences.

Arrays are unnested and reduced in the same stage: unnesting, loss arithmetic and partial
aggregation run in generated code, and each task sends on one row per group. What a
per-sequence mean needs (the sequence's token count) is taken from the arrays before they are
unnested, so no mode has to shuffle tokens or sequences.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.losses import LOSS_MODES, MEAN_EPSILON, check_loss_mode
from prefloom.schemas import IGNORED_LABEL


def token_rows(df: DataFrame, mask: str, arrays: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per token: ``keep``, its place ``_pos``, its mask ``_mask``, the sequence's mask
    count ``_kept``, and one column per entry of ``arrays`` (output name to array column)."""
    zipped = F.arrays_zip(F.col(mask).alias("_mask"), *[F.col(source).alias(name) for name, source in arrays.items()])
    kept = F.array_size(F.filter(F.col(mask), lambda m: m))
    tokens = df.select(*keep, kept.alias("_kept"), F.posexplode(zipped).alias("_pos", "_token"))
    return tokens.select(*keep, "_kept", "_pos", "_token.*")


def _reduced(loss: Column, mode: str) -> Column:
    masked = F.when(F.col("_mask"), loss)
    sequences = F.sum(F.when((F.col("_pos") == 0) & (F.col("_kept") > 0), F.lit(1)))
    if check_loss_mode(mode) == "token-mean":
        return F.sum(masked) / F.count(masked)
    if mode == "seq-mean-token-sum":
        return F.sum(masked) / sequences
    return F.sum(masked / (F.col("_kept") + F.lit(MEAN_EPSILON))) / sequences


def reduce_losses(
    tokens: DataFrame, losses: Mapping[str, Column], mode: str = "seq-mean-token-mean", by: Sequence[str] = ()
) -> DataFrame:
    """Aggregate token losses in one of the three modes; sequences without a kept token count
    for nothing."""
    return tokens.groupBy(*by).agg(*[_reduced(loss, mode).alias(name) for name, loss in losses.items()])


def losses_by_mode(tokens: DataFrame, losses: Mapping[str, Column], modes: Sequence[str] = LOSS_MODES) -> DataFrame:
    """(mode, one column per loss) over all tokens, every mode from the same pass."""
    rows = [F.struct(F.lit(m).alias("mode"), *[_reduced(loss, m).alias(name) for name, loss in losses.items()]) for m in modes]
    return tokens.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def agg_losses(df: DataFrame, losses: str, mask: str, modes: Sequence[str] = LOSS_MODES) -> DataFrame:
    """(mode, loss) for arrays of token losses, all modes from one pass."""
    tokens = token_rows(df, mask, {"loss": losses})
    wide = tokens.agg(*[_reduced(F.col("loss"), mode).alias(mode) for mode in modes])
    return wide.unpivot([], list(modes), "mode", "loss")


def masked_mean_over(df: DataFrame, values: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Masked mean over all tokens of all sequences."""
    tokens = token_rows(df, mask, {"value": values}, keep=by).where("_mask")
    return tokens.groupBy(*by).agg((F.sum("value") / (F.count("*") + F.lit(MEAN_EPSILON))).alias("masked_mean"))


def token_cross_entropy(df: DataFrame, log_probs: str, labels: str, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Mean negative log-probability over the labels that are not ignored, per batch."""
    pairs = F.arrays_zip(F.col(log_probs).alias("log_prob"), F.col(labels).alias("label"))
    tokens = df.select(*by, F.inline(pairs)).where(F.col("label") != IGNORED_LABEL)
    return tokens.groupBy(*by).agg((-F.avg("log_prob")).alias("cross_entropy"), F.count("*").alias("n_tokens"))
