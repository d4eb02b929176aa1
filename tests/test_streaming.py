import json

import pytest
from pyspark.sql import functions as F

from prefloom.schemas import COMPARISON
from prefloom.streaming import jobs as st
from test_records import record


def test_new_files_are_added_once(spark, tmp_path):
    source, target, checkpoint = (tmp_path / n for n in ("in", "out", "checkpoint"))
    source.mkdir()

    def run():
        flat = st.stream_comparisons(spark, str(source)).select("info.id", "split", "chosen")
        st.append_stream(flat, str(target), str(checkpoint)).awaitTermination()
        return sorted((r.id, r.split) for r in spark.read.parquet(str(target)).collect())

    def put(name, *records):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in records))

    put("a.json", record(), record(split="valid1", batch="cnndm0"))
    assert run() == [("1", "train")]
    put("b.json", record(info={"id": "2"}, split="valid2"))
    assert run() == [("1", "train"), ("2", "validation")]
    assert run() == [("1", "train"), ("2", "validation")]
    assert COMPARISON["choice"].dataType.typeName() == "integer"


def test_running_means_equal_the_batch_mean(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.range(60).select((F.col("id") % 3).alias("key"), (F.col("id") * 0.5).alias("score"))
    rows.repartition(4).write.parquet(source)

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        st.update_means(st.running_means(stream, "key", "score"), target, checkpoint).awaitTermination()
        return sorted(map(tuple, st.latest_means(spark, target, "key").collect()))

    def batch():
        means = spark.read.parquet(source).groupBy("key").agg(F.avg("score"), F.count("score"))
        return sorted(map(tuple, means.collect()))

    assert run() == batch()
    rows.limit(7).write.mode("append").parquet(source)
    assert run() == batch()


def test_means_take_the_space_of_keys_not_of_batches(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.range(300).select((F.col("id") % 7).alias("key"), (F.col("id") * 0.5).alias("score"))
    schema = rows.schema

    def run(low, high):
        rows.where(f"key * 0 + score * 2 >= {low} AND score * 2 < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        st.update_means(st.running_means(stream, "key", "score"), target, checkpoint, ring=2).awaitTermination()
        return sorted(map(tuple, st.latest_means(spark, target, "key").collect()))

    def batch():
        return sorted(map(tuple, spark.read.parquet(source).groupBy("key").agg(F.avg("score"), F.count("score")).collect()))

    for low in range(0, 210, 30):
        assert run(low, low + 30) == batch()
    assert sorted(p.name for p in (tmp_path / "out" / "changes").iterdir() if p.is_dir()) == ["slot=0", "slot=1"]
    assert sorted(p.name for p in (tmp_path / "out" / "snapshots").iterdir()) == ["slot=0", "slot=1"]
    # A key that changed long ago is in the snapshot only, and a snapshot cut short does not count.
    spark.createDataFrame([(99, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run(210, 210)
    for low in range(210, 300, 15):
        assert run(low, low + 15) == batch()
    newest = max((tmp_path / "out" / "snapshots").iterdir(), key=lambda p: p.stat().st_mtime)
    next(newest.glob("part-*.parquet")).unlink()
    left = {r.key for r in st.latest_means(spark, target, "key").collect()}
    assert 99 in left and left == {r.key for r in spark.read.parquet(source).select("key").distinct().collect()}


def test_a_broken_line_fails_the_stream_whatever_it_reads(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(record()) + "\n" + json.dumps({**record(), "extra": 5}) + "\n")
    stream = st.stream_comparisons(spark, str(source)).select("split", "chosen")
    query = st.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        query.awaitTermination()


def test_broken_lines_go_aside_once(spark, tmp_path):
    source, target, aside, checkpoint = (tmp_path / n for n in ("in", "good", "aside", "checkpoint"))
    source.mkdir()

    def run():
        st.append_checked(st.stream_checked(spark, "comparisons", str(source)), str(target), str(aside), str(checkpoint)).awaitTermination()
        return spark.read.parquet(str(target)).count(), sorted(r.reason for r in spark.read.parquet(str(aside)).collect())

    (source / "a.json").write_text(json.dumps(record()) + "\n\n{\n")
    assert run() == (1, ["not JSON"])
    (source / "b.json").write_text(json.dumps(record()) + "\n" + json.dumps({**record(), "choice": None}) + "\n")
    assert run() == (2, ["no choice", "not JSON"]) == run()
