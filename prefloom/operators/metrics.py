"""Step-keyed metrics: long form, cadence and checkpoint picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.operators.ordering import ROWS_PER_BUCKET, range_bucket
from prefloom.session import cut_lineage


def is_cadence_step(step: Column, every: int, offset: int = 1, last_step: int | None = None) -> Column:
    """True on every ``every``-th step. Offset 1 counts steps from 0, offset 0 from 1; with
    ``last_step``, steps from there on are kept as well."""
    due = (step + offset) % every == 0
    return due if last_step is None else due | (step >= last_step)


def long_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Wide rows (run, step, one column per metric) as (run, step, metric, value)."""
    values = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select("run", "step", *values).unpivot(["run", "step"], list(metrics), "metric", "value")


def best_so_far(
    df: DataFrame, loss: str, run: str = "run", step: str = "step", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rows whose loss is strictly below every earlier loss of their run.

    The steps are cut into ranges, and the best of the earlier ranges is written down for each:
    a table whose size is then known, so that it is broadcast while it is small. A row that does
    not beat it is dropped before anything is shuffled; what is left is compared inside its
    range. So a run may be of any length without one task reading all of it.
    """
    finite = df.where(F.col(loss) < F.lit(float("inf")))  # neither NULL nor NaN can be a best
    marked = finite.withColumns({"_run": F.struct(run), "_bucket": range_bucket(finite, step, rows_per_bucket)})
    lows = marked.groupBy("_run", "_bucket").agg(F.min(loss).alias("_low"))
    earlier = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bars = cut_lineage(lows.select("_run", "_bucket", F.min("_low").over(earlier).alias("_bar")))
    beats_bar = F.col("_bar").isNull() | (F.col(loss) < F.col("_bar"))
    left = marked.join(bars, ["_run", "_bucket"]).where(beats_bar)
    inside = Window.partitionBy("_run", "_bucket").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    ranked = left.withColumn("_best", F.min(loss).over(inside))
    best = ranked.where(F.col("_best").isNull() | (F.col(loss) < F.col("_best")))
    return best.drop("_run", "_bucket", "_bar", "_best")


def reward_report(reward: Column, text: Column) -> Column:
    """One text record: the reward, the text, and a rule."""
    return F.concat(F.format_string("Reward: %.4f\n", reward), text, F.lit("\n" + "=" * 100))
