"""Groups of responses to one prompt: size check and group-relative advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.sequences import spread_advantage
from prefloom.operators.skew import HOT_ROWS, hot_keys, is_one_of

STD_EPSILON = 1e-7


def _fail_unless_size(n: Column, group: Column, size: int) -> Column:
    message = F.format_string(f"group %s has %d responses, expected {size}", group.cast("string"), n)
    return F.when(n == size, n).otherwise(F.raise_error(message).cast("bigint"))


def check_group_size(df: DataFrame, group: str, size: int) -> DataFrame:
    """One row per group with its size; running it fails on a group of any other size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.withColumn("n", _fail_unless_size(F.col("n"), F.col(group), size))


def _advantage(score: str, mean: Column, std: Column, normalize: bool) -> Column:
    centred = F.col(score) - mean
    # A group of one has no deviation; a NULL score has no advantage either way.
    return centred / (F.coalesce(std, F.lit(0.0)) + F.lit(STD_EPSILON)) if normalize else centred


def group_advantage(
    df: DataFrame,
    group: str,
    score: str = "score",
    normalize: bool = True,
    group_size: int | None = None,
    min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Score minus the group mean, divided by the group's sample deviation if ``normalize``. A
    group of one gets advantage 0.

    Ordinary groups take one shuffle and a window. A group holding a large share of the rows is
    reduced by partial aggregates instead, and its mean and deviation go out with a broadcast,
    so its rows stay where they are. With ``group_size``, a group of any other size fails the
    query.
    """
    whole = Window.partitionBy(group)

    def checked(advantage: Column, n: Column) -> Column:
        if group_size is None:
            return advantage
        return F.when(_fail_unless_size(n, F.col(group), group_size) > 0, advantage)

    def by_window(rows: DataFrame) -> DataFrame:
        mean, std = F.avg(score).over(whole), F.stddev_samp(score).over(whole)
        advantage = _advantage(score, mean, std, normalize)
        return rows.withColumn("advantage", checked(advantage, F.count("*").over(whole)))

    hot = hot_keys(df, group, min_hot_rows)
    if not hot:
        return by_window(df)
    is_hot = is_one_of(F.col(group), hot)
    large = df.where(is_hot)
    stats = large.groupBy(F.col(group).alias("_group")).agg(
        F.count("*").alias("_n"), F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_std")
    )
    advantage = _advantage(score, F.col("_mean"), F.col("_std"), normalize)
    joined = large.join(F.broadcast(stats), F.col(group).eqNullSafe(F.col("_group")))
    from_stats = joined.withColumn("advantage", checked(advantage, F.col("_n")))
    return by_window(df.where(~is_hot)).unionByName(from_stats.drop("_group", "_n", "_mean", "_std"))


def broadcast_advantage(df: DataFrame, mask: str, advantage: str = "advantage", out: str = "advantages") -> DataFrame:
    """The advantage of each sequence on each of its unmasked response tokens."""
    return df.withColumn(out, spread_advantage(F.col(advantage), F.col(mask)))


def fan_out(df: DataFrame, copies: int, name: str = "response_no") -> DataFrame:
    """Every row ``copies`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
