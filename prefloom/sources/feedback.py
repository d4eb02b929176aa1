"""Human-feedback records from JSON lines, read with their declared schemas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.schemas import AXIS_EVAL, COMPARISON

# The files of each kind in the published data set, in its order.
COMPARISON_FILES = (
    "batch3.json", "batch4.json", "batch5.json", "batch10.json", "batch11.json", "batch12.json",
    "batch13.json", "batch14.json", "batch15.json", "batch16.json", "batch17.json", "batch18.json",
    "batch19.json", "batch20.json", "batch22.json", "batch6.json", "batch7.json", "batch8.json", "batch9.json",
    "batch0_cnndm.json", "cnndm0.json", "cnndm2.json", "edit_b2_eval_test.json",
)
AXIS_FILES = ("cnndm1.json", "cnndm3.json", "cnndm4.json", "tldraxis1.json", "tldraxis2.json")

CORRUPT = "_broken"


@dataclass(frozen=True)
class FeedbackKind:
    schema: T.StructType
    folder: str
    files: tuple[str, ...]


KINDS = {
    "comparisons": FeedbackKind(COMPARISON, "comparisons", COMPARISON_FILES),
    "axis": FeedbackKind(AXIS_EVAL, "axis_evals", AXIS_FILES),
}


def feedback_kind(kind: str) -> FeedbackKind:
    if kind not in KINDS:
        raise ValueError(f"unknown feedback kind {kind!r}; choose from {sorted(KINDS)}")
    return KINDS[kind]


def published_paths(kind: str, root: str) -> list[str]:
    """Where the published files of a kind lie below ``root``."""
    entry = feedback_kind(kind)
    return [f"{root.rstrip('/')}/{entry.folder}/{name}" for name in entry.files]


def _filled(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(F.btrim("value")) > 0)


def parsed_lines(lines: DataFrame, kind: str) -> DataFrame:
    """The records of text lines (``value``), batch or stream. Keys absent from a record read as NULL; blank lines are
    skipped; any other line that does not fit the schema fails the query, whichever columns it reads."""
    schema = feedback_kind(kind).schema
    # The filter needs the whole record, so no column is pruned before it was checked.
    records = _filled(lines).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"))
    return records.where(F.col("record").isNotNull()).select("record.*")


def feedback_lines(spark: SparkSession, kind: str, paths: str | list[str], without: Sequence[str] = ()) -> DataFrame:
    """The lines of a kind's files or folders, but for the files named after the batches ``without``: Spark leaves these out
    when it lists the files, so they are not opened."""
    feedback_kind(kind)
    lines = spark.read.text(paths)
    if without:
        lines = lines.where(~F.col("_metadata.file_name").isin([f"{batch}.json" for batch in without]))
    return lines.select("value")


def read_feedback(spark: SparkSession, kind: str, paths: str | list[str], without: Sequence[str] = ()) -> DataFrame:
    """Records of a kind from files or folders, as ``parsed_lines`` has them, without the files of some batches.

    ``exclude_batches`` judges record by record; ``without`` is for batches that no split needs and that have
    files of their own, as the published ones do.
    """
    return parsed_lines(feedback_lines(spark, kind, paths, without), kind)


def checked_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Rows (line, record, reason) of all lines but blank ones, batch or stream: a record, or the reason why there is none.

    Reasons: "not JSON", "not an object", "does not fit: " with the top-level fields of another type (without
    names where the misfit lies deeper), and for comparisons "no choice", "no such summary" (the choice names none)
    and "fewer than two summaries". One projection: nothing is read twice and nothing is lost.
    """
    schema = feedback_kind(kind).schema
    broken = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = _filled(lines).select(
        F.col("value").alias("line"), F.from_json("value", broken, how).alias("r"), F.try_parse_json("value").alias("v")
    )

    def misfit(name: str) -> Column:
        stated = F.try_variant_get("v", f"$.{name}", "string").isNotNull()
        return F.when(stated & F.col(f"r.{name}").isNull(), F.lit(name))

    names = F.array_compact(F.array(*[misfit(f.name) for f in schema.fields]))
    where = F.when(F.size(names) > 0, F.concat(F.lit(": "), F.array_join(names, ", "))).otherwise(F.lit(""))
    reason = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not an object")
        .when(F.col(f"r.{CORRUPT}").isNotNull(), F.concat(F.lit("does not fit"), where))
    )
    if kind == "comparisons":
        reason = (
            reason.when(F.col("r.choice").isNull(), "no choice")
            .when(F.coalesce(F.size("r.summaries"), F.lit(0)) < 2, "fewer than two summaries")
            .when((F.col("r.choice") < 0) | (F.col("r.choice") >= F.size("r.summaries")), "no such summary")
        )
    record = F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    judged = rows.select("line", record.alias("record"), reason.alias("reason"))
    return judged.withColumn("record", F.when(F.col("reason").isNull(), F.col("record")))


def read_checked(spark: SparkSession, kind: str, paths: str | list[str], without: Sequence[str] = ()) -> DataFrame:
    """All lines of files or folders with their records or reasons, without the files of some batches."""
    return checked_lines(feedback_lines(spark, kind, paths, without), kind)


def good_records(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).select("record.*")


def set_aside(checked: DataFrame) -> DataFrame:
    """Rows (line, reason) to be looked at by someone."""
    return checked.where(F.col("reason").isNotNull()).select("line", "reason")


def read_comparisons(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_feedback(spark, "comparisons", paths)


def read_axis_evals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_feedback(spark, "axis", paths)
