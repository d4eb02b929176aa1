"""Comparison records: split routing, batch filter, chosen and rejected texts, lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import format_response
from prefloom.functions.subwords import Tokenizer
from prefloom.schemas import NEWS_BATCHES

# How the source's split names map to data set splits.
COMPARISON_SPLITS = {"train": "train", "valid1": "validation", "valid2": "validation"}
AXIS_SPLITS = {"test": "test", "valid1": "validation", "valid2": "validation"}

# The columns each task reads.
TASK_COLUMNS = {
    "sft": ("query_and_response_tokens", "query_and_response_labels"),
    "reward": ("query_and_chosen_response_tokens", "query_and_rejected_response_tokens"),
    "dpo": (
        "query_and_chosen_response_tokens",
        "query_and_rejected_response_tokens",
        "query_token_length_without_padding",
    ),
    "rollout": ("query_tokens",),
    "scoring": ("query_and_response_tokens",),
}


def project_for(df: DataFrame, task: str, keys: Sequence[str] = ()) -> DataFrame:
    """Only the columns a task needs, plus ``keys``; the scan reads nothing else."""
    if task not in TASK_COLUMNS:
        raise ValueError(f"unknown task {task!r}; choose from {sorted(TASK_COLUMNS)}")
    return df.select(*keys, *TASK_COLUMNS[task])


def routed_split(split: Column, routes: Mapping[str, str] = COMPARISON_SPLITS) -> Column:
    out: Column | None = None
    for name, target in routes.items():
        out = F.when(split == name, F.lit(target)) if out is None else out.when(split == name, F.lit(target))
    unknown = F.concat(F.coalesce(split, F.lit("NULL")), F.lit(" is an unrecognized dataset split."))
    return out.otherwise(F.raise_error(unknown).cast("string"))


def route_split(df: DataFrame, routes: Mapping[str, str] = COMPARISON_SPLITS) -> DataFrame:
    """Map the source's split names to data set splits; any other name fails the query."""
    return df.withColumn("split", routed_split(F.col("split"), routes))


def exclude_batches(df: DataFrame, batches: Sequence[str] = NEWS_BATCHES, split: str = "validation") -> DataFrame:
    """Drop rows of ``split`` whose batch is listed; a NULL batch is kept."""
    listed = F.coalesce(F.col("batch").isin(*batches), F.lit(False))
    return df.where((F.col("split") != split) | ~listed)


def chosen_and_rejected(summaries: Column, choice: Column) -> tuple[Column, Column]:
    """Texts of the preferred and the other summary. A choice other than 0 and 1 fails the query, NULL included,
    and so does a record with fewer than two summaries; a NULL text stays NULL."""
    got = F.coalesce(choice.cast("string"), F.lit("NULL"))
    wrong = F.raise_error(F.concat(F.lit("choice must be 0 or 1, got "), got)).cast("int")
    few = F.raise_error(F.lit("a comparison needs two summaries")).cast("int")
    whole = F.coalesce(F.array_size(F.filter(summaries, lambda s: s.isNotNull())) >= 2, F.lit(False))
    index = F.when(~F.coalesce(choice.isin(0, 1), F.lit(False)), wrong).when(~whole, few).otherwise(choice)
    return F.get(summaries, index)["text"], F.get(summaries, F.lit(1) - index)["text"]


def pick_chosen_rejected(df: DataFrame) -> DataFrame:
    chosen, rejected = chosen_and_rejected(F.col("summaries"), F.col("choice"))
    return df.withColumns({"chosen": chosen, "rejected": rejected})


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def response_length_stats(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Token lengths, end marker included, over chosen and rejected responses of each split."""
    picked = pick_chosen_rejected(df)
    lengths = picked.select(
        "split",
        F.explode(
            F.array(
                tokenizer.count(format_response(F.col("chosen"))),
                tokenizer.count(format_response(F.col("rejected"))),
            )
        ).alias("length"),
    )
    # Lengths repeat, so a table of their counts is small and still exact.
    histogram = lengths.groupBy("split", "length").agg(F.count("*").alias("n"))
    return histogram.groupBy("split").agg(
        F.sum("n").alias("n_responses"),
        F.max("length").alias("max_length"),
        (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean_length"),
        F.percentile("length", 0.99, F.col("n")).alias("p99_length"),
    )


def assemble_splits(**splits: DataFrame) -> DataFrame:
    """Frames named by split as one frame with a ``split`` column."""
    out: DataFrame | None = None
    for name, df in splits.items():
        part = df.drop("split").withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits given")
    return out
