"""Reproducible shuffles, global row positions, batches and first-n.

A position is a bucket's offset plus a rank inside the bucket. Buckets are ranges of the sort
key, so the order is that of one full sort, yet no task ever holds more than a bucket, and the
table of offsets has at most one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.operators.skew import bounded_sample

HASH_DIGITS = 4  # 65,536 buckets of the md5 key
ROWS_PER_BUCKET = 100_000
MIN_BUCKETS = 16
MAX_BUCKETS = 16_384
# Keys looked at to bound a large head.
FIRST_SAMPLE = 10_000
SMALL_LIMIT = 10_000


def shuffle_key(id_column: Column, seed: int, epoch: int | Column = 0) -> Column:
    """A key whose sort order is a permutation fixed by (seed, epoch, id) alone."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), id_column.cast("string")))


def seeded_shuffle(df: DataFrame, id_column: str, seed: int, epoch: int = 0) -> DataFrame:
    """The rows in a reproducible random order, with their ``shuffle_key``. Ids must be unique."""
    return df.withColumn("shuffle_key", shuffle_key(F.col(id_column), seed, epoch)).orderBy("shuffle_key", id_column)


def _positions(df: DataFrame, bucket: Column, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    marked, group = df.withColumn("_bucket", bucket), []
    if by:
        # A struct is never NULL itself, so that rows with a NULL group find their offsets.
        marked, group = marked.withColumn("_by", F.struct(*by)), ["_by"]
    counts = marked.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if not by:
        offsets = F.broadcast(offsets)  # at most one row per bucket
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    placed = marked.withColumn("_rank", rank).join(offsets, [*group, "_bucket"])
    return placed.withColumn(name, F.col("_offset") + F.col("_rank") - 1).drop("_by", "_bucket", "_rank", "_offset")


def shuffled_positions(
    df: DataFrame,
    id_column: str,
    seed: int,
    epoch: int | Column = 0,
    by: Sequence[str] = (),
    name: str = "position",
    hash_digits: int = HASH_DIGITS,
) -> DataFrame:
    """0-based position of each row in the seeded shuffle, counted within ``by`` if given."""
    keyed = df.withColumn("_key", shuffle_key(F.col(id_column), seed, epoch))
    bucket = F.substring("_key", 1, hash_digits)
    return _positions(keyed, bucket, ["_key", id_column], by, name).drop("_key")


def range_bucket(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """A column numbering about equal ranges of a numeric or timestamp ``key`` in its order.

    The bounds come from a sample of the key, as in a range-partitioned sort, and then are
    constants of the plan: every use of the column and every repeated task sees the same ranges.
    """
    kind = df.schema[key].dataType.typeName()
    if kind in ("string", "binary", "boolean", "array", "map", "struct"):
        raise TypeError(f"{key!r} has type {kind}; order by a number or time, or use the seeded shuffle")
    value = F.col(key).cast("double")
    sample, n, _ = bounded_sample(df.select(value.alias("value")))
    buckets = int(min(max(n // rows_per_bucket, MIN_BUCKETS), MAX_BUCKETS))
    shares = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
    found = sample.agg(F.percentile_approx("value", shares, buckets * 16).alias("bounds")).first()["bounds"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    powers = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def descend(low: Column, power: Column) -> Column:
        ahead = low + power
        fits = (ahead <= len(bounds)) & (F.get(table, ahead - 1) <= value)
        return F.when(fits, ahead).otherwise(low)

    return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), descend)


def ordered_positions(
    df: DataFrame, key: str, name: str = "position", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """0-based position of each row in the order of a unique numeric or timestamp key."""
    return _positions(df, range_bucket(df, key, rows_per_bucket), [key], (), name)


def assign_batches(
    df: DataFrame, size: int, id_column: str, seed: int | None = None, epoch: int = 0
) -> DataFrame:
    """Consecutive batch ids over the seeded shuffle, or over the id order without a seed; the
    last batch may be short."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    placed = (
        ordered_positions(df, id_column) if seed is None else shuffled_positions(df, id_column, seed, epoch)
    )
    return placed.withColumn("batch_id", F.floor(F.col("position") / size))


def assign_groups(df: DataFrame, group_size: int, id_column: str) -> DataFrame:
    """Consecutive rows of the id order become groups of ``group_size``."""
    placed = ordered_positions(df, id_column)
    return placed.withColumn("group_id", F.floor(F.col("position") / group_size)).drop("position")


def assign_minibatches(
    df: DataFrame, id_column: str, updates: int, mini_size: int, micro_size: int, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Every row once per update pass, with its mini-batch and the micro-batch inside it.
    Each pass has its own permutation of the rows (of each ``by`` group)."""
    passes = df.withColumn("update", F.explode(F.sequence(F.lit(0), F.lit(updates - 1))))
    placed = shuffled_positions(passes, id_column, seed, F.col("update"), by=[*by, "update"])
    inside = F.col("position") % mini_size
    return placed.withColumn("mini_batch", F.floor(F.col("position") / mini_size)).withColumn(
        "micro_batch", F.floor(inside / micro_size)
    )


def take_first(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first ``n`` rows by a unique key of any ordered type, in that order; all rows for ``None``.

    Small heads use a top-n sort. For large ones a sampled bound leaves little more than ``n`` rows, and a
    top-n sort of what is too much finds the exact end, so no task holds all ``n`` rows.
    """
    if n is None:
        return df
    if n <= SMALL_LIMIT:
        return df.orderBy(key).limit(n)
    sample, _, fraction = bounded_sample(df.select(key), FIRST_SAMPLE)
    known = [row[0] for row in sample.where(F.col(key).isNotNull()).orderBy(key).collect()]
    place = int(n * fraction + 4 * (n * fraction) ** 0.5 + 10)
    near = df.where(F.col(key).isNull() | (F.col(key) <= F.lit(known[place]))) if place < len(known) else df
    over = near.count() - n
    if over < 0 and place < len(known):
        near, over = df, df.count() - n
    if over <= 0:
        return near.orderBy(key)
    end = near.orderBy(F.desc(key)).limit(over).agg(F.min(key)).first()[0]
    return near.where(F.col(key).isNull() | (F.col(key) < F.lit(end))).orderBy(key)
