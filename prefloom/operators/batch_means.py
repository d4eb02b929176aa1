"""Averages the way training and evaluation loops report them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def mean_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def mean_of_batch_means(df: DataFrame, metrics: Sequence[str], batch: str = "batch_id", by: Sequence[str] = ()) -> DataFrame:
    """The mean of each batch, then the plain mean of those: a short last batch weighs as much
    as a full one."""
    per_batch = df.groupBy(*by, batch).agg(*[F.avg(m).alias(m) for m in metrics])
    return per_batch.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("batches"))


def accumulated_steps(
    df: DataFrame, index: str, metrics: Sequence[str], accumulation: int, by: Sequence[str] = (), keep_tail: bool = False
) -> DataFrame:
    """Sums of ``metric / accumulation`` over consecutive micro-batches. A tail shorter than
    ``accumulation`` emits no step unless ``keep_tail``."""
    steps = df.groupBy(*by, F.floor(F.col(index) / accumulation).alias("step")).agg(
        F.count("*").alias("micro_batches"),
        *[(F.sum(m) / F.lit(float(accumulation))).alias(m) for m in metrics],
    )
    return steps if keep_tail else steps.where(F.col("micro_batches") == accumulation)


def rollout_mean_reward(df: DataFrame, reward: Column, by: Sequence[str] = ("step",)) -> DataFrame:
    """Mean over sequences of their summed token rewards."""
    return df.groupBy(*by).agg(F.avg(reward).alias("mean_reward"), F.count("*").alias("n"))


def update_budget(
    df: DataFrame, batch_size: int, accumulation: int, epochs: int, warmup_ratio: float, by: str = "split"
) -> DataFrame:
    """Batches, optimizer updates and warm-up steps that each split's row count implies."""
    rows = df.groupBy(by).agg(F.count("*").alias("n_rows"))
    batches = F.ceil(F.col("n_rows") / batch_size)
    per_epoch = F.ceil(F.col("batches") / accumulation)
    return (
        rows.withColumn("batches", batches)
        .withColumn("updates_per_epoch", per_epoch)
        .withColumn("total_updates", F.col("updates_per_epoch") * epochs)
        .withColumn("warmup_steps", F.floor(F.col("updates_per_epoch") * F.lit(warmup_ratio)))
    )
