"""Joins and groups that hold when one key owns a large share of the rows.

Hot keys are found on a sample of the key column; which keys count as hot decides how rows
travel, never what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys
# can be hot whatever the data size, and anything unique per hot key may be broadcast.
HOT_SHARE = 1024
# A key with fewer rows than this never needs special care.
HOT_ROWS = 100_000
SAMPLE_ROWS = 1_000_000
# What the rows of one hot key are cut into for a join.
SLICES = 256


def bounded_sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, int, float]:
    """About ``rows`` rows of ``df`` (all of a smaller one), the row count of ``df``, and the
    fraction the sample is of it."""
    n = df.count()
    if n <= rows:
        return df, n, 1.0
    return df.sample(rows / n, seed=17), n, rows / n


def frequent_keys(sample: DataFrame, key: str, sampled: int, fraction: float, min_rows: int = HOT_ROWS) -> list:
    """Keys (NULL among them) that hold more than 1/HOT_SHARE of the ``sampled`` rows and, the
    sample being ``fraction`` of the table, stand for more than ``min_rows`` of its rows."""
    least = max(sampled / HOT_SHARE, min_rows * fraction)
    counts = sample.groupBy(key).agg(F.count("*").alias("_n"))
    return [row[0] for row in counts.where(F.col("_n") > least).limit(HOT_SHARE).select(key).collect()]


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> list:
    """The hot keys of a table; reads nothing but the key column."""
    sample, n, fraction = bounded_sample(df.select(key))
    return [] if n <= min_rows else frequent_keys(sample, key, int(n * fraction), fraction, min_rows)


def is_one_of(column: Column, keys: Sequence) -> Column:
    """Whether a column is one of the keys; never NULL, and true for NULL if that is a key."""
    known = [k for k in keys if k is not None]
    listed = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
    return listed | column.isNull() if None in keys else listed


def join_unique(
    rows: DataFrame, lookup: DataFrame, key: str, hot: Sequence, spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` with unique keys, without sending a hot key to one task.

    The rows of a hot key are dealt out to slices by a hash of ``spread_by``, which stays the
    same when a task runs again, and its lookup row is repeated once per slice.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join {how!r}")
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = is_one_of(F.col(key), hot)
    dealt = F.pmod(F.xxhash64(*spread_by), F.lit(SLICES)).cast("int")
    sliced = rows.withColumn("_slice", F.when(is_hot, dealt).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    return sliced.join(lookup.withColumn("_slice", F.explode(copies)), [key, "_slice"], how).drop("_slice")
