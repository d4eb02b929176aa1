"""Versions of a table that are readable only when they are whole.

A version is a folder of its own and one row in the log of its table, ``<base>_published``: manifest and pointer in
one. The row is appended after the rows written were counted twice, as they passed the writer and as they are
stored, so a write that is killed at any point leaves a folder that no reader looks at and that the next attempt
overwrites. The current version is the greatest in the log (stamps like 20250101_000000 sort by time).
Two publishers of one table at a time are not coordinated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefloom.sources.tables import manifest, versioned_path

LOG = "version string, source string, columns string, params string, splits array<struct<split: string, n_rows: bigint>>, ddl string"


def log_path(base: str) -> str:
    return f"{base.rstrip('/')}_published"


def published(spark: SparkSession, base: str) -> DataFrame:
    """The log of a table: one row per version; none where nothing was published yet."""
    try:
        return spark.read.schema(LOG).json(log_path(base))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def publish(df: DataFrame, base: str, version: str, params: object, source: str) -> str:
    """Write ``df`` (with a column ``split``) as a version, and log it once it is whole; returns its folder.

    ``df`` is evaluated once. A version that is in the log already is refused; one that is not, but has a
    folder, is what a killed attempt left, and is overwritten. NULL splits are kept.
    """
    spark, base = df.sparkSession, base.rstrip("/")
    if not published(spark, base).where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version!r} of {base} is published already")
    passed = Observation("rows")
    path = versioned_path(base, version)
    df.observe(passed, F.count("*").alias("n")).write.mode("overwrite").partitionBy("split").parquet(path)
    row = manifest(_stored(spark, path, df.schema.toDDL()), params, source)
    row = row.select(F.lit(version).alias("version"), "source", "columns", "params", "splits", F.lit(df.schema.toDDL()).alias("ddl"))
    log_row = row.first()
    stored = sum(s["n_rows"] for s in log_row["splits"] or [])
    if stored != passed.get["n"]:
        raise RuntimeError(f"{passed.get['n']} rows were written to {path}, {stored} are stored; the version is not published")
    spark.createDataFrame([log_row], LOG).coalesce(1).write.mode("append").json(log_path(base))
    return path


def _stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    # Files of another attempt cannot be among them: overwriting removed the folder, and Spark commits whole jobs.
    schema = StructType.fromDDL(ddl)
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in schema.names])


def read_published(spark: SparkSession, base: str, version: str | None = None, split: str | None = None) -> DataFrame:
    """The current version of a table or a named one, or one split of it. Fails where that was never published."""
    log = published(spark, base)
    rows = log if version is None else log.where(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).limit(1).collect()
    if not row:
        raise LookupError(f"no version of {base} is published" if version is None else f"version {version!r} of {base} is not published")
    df = _stored(spark, versioned_path(base.rstrip("/"), row[0]["version"]), row[0]["ddl"])
    return df if split is None else df.where(F.col("split") == split)
