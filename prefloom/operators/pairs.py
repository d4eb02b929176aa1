"""Chosen/rejected pairs: stacking for one scoring pass, unstacking, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.losses import dpo_loss, dpo_margin, pair_loss

SIDES = ("chosen", "rejected")


def stack_pairs(df: DataFrame, keys: Sequence[str], **columns: tuple[str, str]) -> DataFrame:
    """One row per side: ``columns`` maps an output name to its (chosen, rejected) columns."""
    sides = [
        F.struct(F.lit(side).alias("side"), *[F.col(pair[i]).alias(name) for name, pair in columns.items()])
        for i, side in enumerate(SIDES)
    ]
    return df.select(*keys, F.inline(F.array(*sides)))


def unstack_pairs(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Back to one row per pair: the columns ``chosen`` and ``rejected`` for one value, and
    ``<value>_chosen`` and ``<value>_rejected`` for several."""
    return df.groupBy(*keys).agg(
        *[
            F.first(F.when(F.col("side") == side, F.col(value)), ignorenulls=True).alias(
                side if len(values) == 1 else f"{value}_{side}"
            )
            for side in SIDES
            for value in values
        ]
    )


def win(better: Column) -> Column:
    """1 where the condition holds, 0 elsewhere; ties count as wrong."""
    return F.when(better, F.lit(1.0)).otherwise(F.lit(0.0))


def pair_accuracy(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return df.agg(F.avg(win(F.col(chosen) > F.col(rejected))).alias("accuracy"))


def reward_pair_metrics(df: DataFrame) -> DataFrame:
    """Loss and correctness of each pair of scores."""
    chosen, rejected = F.col("chosen"), F.col("rejected")
    return df.withColumns({"loss": pair_loss(chosen, rejected), "correct": win(chosen > rejected)})


def dpo_pair_metrics(df: DataFrame, beta: float, label_smoothing: float = 0.0) -> DataFrame:
    """Margin, loss and correctness of each pair of policy and reference log-probabilities."""
    margin = dpo_margin(
        F.col("policy_chosen"), F.col("ref_chosen"), F.col("policy_rejected"), F.col("ref_rejected")
    )
    with_margin = df.withColumn("margin", margin)
    return with_margin.withColumns(
        {"loss": dpo_loss(F.col("margin"), beta, label_smoothing), "correct": win(F.col("margin") > 0)}
    )


def align_policy_reference(policy: DataFrame, old: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Policy, old and reference log-probabilities of the same sequences side by side. Keys are
    unique on each side; each input brings its key and ``log_probs``. A sequence of the policy that
    lacks one of the others fails the query; sequences the policy does not have are left out."""
    out = policy.withColumnRenamed("log_probs", "policy_log_probs")
    for side, name in ((old, "old"), (reference, "ref")):
        column = f"{name}_log_probs"
        other = side.select(key, F.col("log_probs").alias(column), F.lit(True).alias("_there"))
        missing = F.raise_error(F.concat(F.lit(f"no {column} for sequence "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
        kind = side.schema["log_probs"].dataType
        out = out.join(other, key, "left")
        out = out.withColumn(column, F.when(F.col("_there"), F.col(column)).otherwise(missing.cast(kind))).drop("_there")
    return out
