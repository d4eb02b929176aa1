"""Stored tables: split selection, versioned writes, manifests, scores, metrics and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators.metrics import long_metrics, reward_report

SMALL_BYTES = 256 << 20


def read_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A stored table, or one split of it; only that split's folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def spread_small(df: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Deal a small input, which may well lie in a single row group, out to all cores before
    work that is heavy per row. Larger inputs have splits enough and are never shuffled."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(size) < small_bytes else df


def versioned_path(base: str, version: str) -> str:
    return f"{base}_{version}"


def write_versioned(df: DataFrame, base: str, version: str, mode: str = "errorifexists") -> str:
    """Write under ``<base>_<version>``, one folder per split; returns the path. The version is
    the caller's (a ``%Y%m%d_%H%M%S`` stamp, say), so a rerun can name the same one."""
    path = versioned_path(base, version)
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Column descriptions, kept in the schema of what is written."""
    unknown = set(comments) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns])


def manifest(df: DataFrame, params: object, source: str) -> DataFrame:
    """One row: the schema with its comments, the parameters, the source, and rows per split."""
    columns = [
        {"name": f.name, "type": f.dataType.simpleString(), "comment": f.metadata.get("comment", "")}
        for f in df.schema.fields
    ]
    values = asdict(params) if is_dataclass(params) else dict(params)
    per_split = df.groupBy("split").agg(F.count("*").alias("n_rows"))
    counts = F.sort_array(F.collect_list(F.struct("split", "n_rows")))  # one entry per split
    return per_split.agg(counts.alias("splits")).select(
        F.lit(source).alias("source"),
        F.lit(json.dumps(columns)).alias("columns"),
        F.lit(json.dumps(values)).alias("params"),
        "splits",
    )


def write_manifest(df: DataFrame, path: str, params: object, source: str) -> str:
    """Write the manifest of a table beside it, as JSON; returns its path."""
    target = f"{path.rstrip('/')}_manifest"
    manifest(df, params, source).write.mode("overwrite").json(target)
    return target


def write_with_scores(df: DataFrame, path: str, score: Column, name: str = "reward") -> str:
    """Rewrite a table with its scores as ``<path>_with_rewards``; returns that path."""
    target = f"{path.rstrip('/')}_with_rewards"
    df.withColumn(name, score).write.mode("errorifexists").parquet(target)
    return target


def write_text_report(df: DataFrame, path: str, step: str, reward: str, text: str) -> None:
    """Append one text record per row (reward, text, rule) to the folder of its step. Rows of a step meet in one
    task, or in several of bounded size, so a step gets few files."""
    report = df.select(F.col(step).alias("step"), reward_report(F.col(reward), F.col(text)).alias("value"))
    report.hint("rebalance", "step").write.mode("append").partitionBy("step").text(path)


def append_metrics(df: DataFrame, path: str, *metrics: str) -> None:
    """Append wide metric rows to the long metric table (run, step, metric, value)."""
    long_metrics(df, metrics).write.mode("append").parquet(path)
