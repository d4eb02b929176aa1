"""Continuous ingest of comparisons, broken lines set aside, and running mean scores in bounded space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefloom.operators.records import pick_chosen_rejected
from prefloom.plans.examples import prepare_comparisons
from prefloom.sources.feedback import checked_lines, good_records, parsed_lines, set_aside

VALUES = ("mean_score", "n")
RING = 16  # micro-batches whose changes lie beside the snapshot


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New lines (``value``) of the files of a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def stream_comparisons(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New comparison files of a folder as routed, filtered rows with chosen and rejected texts. A line that does not
    fit fails the query, whichever columns it reads; ``stream_checked`` sets such lines aside instead."""
    records = parsed_lines(stream_lines(spark, folder, files_per_trigger), "comparisons")
    return pick_chosen_rejected(prepare_comparisons(records))


def stream_checked(spark: SparkSession, kind: str, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New lines of a folder with their record or the reason why they have none (see ``checked_lines``)."""
    return checked_lines(stream_lines(spark, folder, files_per_trigger), kind)


def append_checked(checked: DataFrame, target: str, aside: str, checkpoint: str) -> StreamingQuery:
    """Records to ``target`` and broken lines with their reasons to ``aside``, each micro-batch in a folder
    ``batch=<id>`` of its own, which it overwrites when it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good_records(kept).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            set_aside(kept).write.mode("overwrite").parquet(f"{aside}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    writer = checked.writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, target: str, checkpoint: str, by: Sequence[str] = ("split",)) -> StreamingQuery:
    """Append to a Parquet table, each input file exactly once; stops when the input is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").partitionBy(*by)
    return writer.option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def running_means(stream: DataFrame, key: str, score: str) -> DataFrame:
    """Mean and count per key so far. The state is one (sum, count) per key."""
    return stream.groupBy(key).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def update_means(means: DataFrame, target: str, checkpoint: str, ring: int = RING) -> StreamingQuery:
    """Keep the current values of ``running_means`` below ``target``, in space for ``ring`` micro-batches and twice the keys.

    A micro-batch writes the keys it changed to its place in a ring of ``ring`` folders; the last of each turn first
    merges the turn into a snapshot of all keys, so what it overwrites later is in there. Two snapshots alternate,
    and one counts only with a marker of as many rows as it has: whatever is cut short, the other one and the
    ring still hold every value. A micro-batch that runs again writes the same places.
    """
    keys = [c for c in means.columns if c not in VALUES]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{target}/changes/slot={batch_id % ring}")
        if batch_id % ring < ring - 1:
            return
        slot = batch_id // ring % 2
        current = _current(spark, target, keys, [1 - slot])
        path = f"{target}/snapshots/slot={slot}"
        current.withColumn("upto", F.lit(batch_id)).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(batch_id).alias("upto"), "n")
        done.write.mode("overwrite").json(f"{target}/markers/slot={slot}")

    writer = means.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(reader: DataFrameReader, kind: str, path: str) -> DataFrame | None:
    """What is stored at a path; None where nothing was written yet."""
    try:
        return getattr(reader, kind)(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _current(spark: SparkSession, target: str, keys: Sequence[str], slots: Sequence[int] = (0, 1)) -> DataFrame | None:
    """The last row (keys, mean_score, n, batch) of each key in the newest whole snapshot of ``slots`` and the ring."""
    whole: list[tuple[int, DataFrame]] = []
    for slot in slots:
        marker = _stored(spark.read.schema("upto long, n long"), "json", f"{target}/markers/slot={slot}")
        rows = _stored(spark.read, "parquet", f"{target}/snapshots/slot={slot}")
        mark = marker.first() if marker is not None else None
        if mark and rows is not None:
            own = rows.where(F.col("upto") == mark["upto"]).drop("upto")
            if own.count() == mark["n"]:
                whole.append((mark["upto"], own))
    changes = _stored(spark.read, "parquet", f"{target}/changes")
    parts = [max(whole, key=lambda w: w[0])[1]] if whole else []
    parts += [changes.drop("slot")] if changes is not None else []
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    latest = F.max_by(F.struct(*VALUES, "batch"), "batch").alias("_last")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_last.*")


def latest_means(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last state of every key; no rows where no batch was written yet. Reads one snapshot and the ring,
    however long the stream has run."""
    rows = _current(spark, target, [key])
    return spark.createDataFrame([], f"{key} string, mean_score double, n bigint") if rows is None else rows.drop("batch")
