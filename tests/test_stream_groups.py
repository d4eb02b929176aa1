from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from prefloom.operators.groups import group_advantage
from prefloom.streaming.groups import GroupCompletion, complete_groups
from prefloom.streaming.jobs import append_stream

SCHEMA = "prompt long, no int, score double"


@pytest.fixture()
def run(spark, tmp_path):
    """Adds a file of rows (prompt, no, score) and runs the stream up to its end, as after a restart."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def add(*rows, **how):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = complete_groups(stream, "prompt", "no", "score", **{"size": 3, **how})
        append_stream(out, target, checkpoint, by=("status",)).awaitTermination()
        return sorted((r.prompt, r.no, r.status, r.advantage and round(r.advantage, 6)) for r in spark.read.parquet(target).collect())

    return add


def test_groups_complete_over_restarts_and_late_ones_go_aside(run):
    assert run((1, 0, 1.0), (2, 0, 5.0), (1, 2, 3.0), (3, 0, 1.0), (3, 1, None), (3, 2, 1.0), (None, 1, 2.0)) == [
        (3, 0, "complete", 0.0), (3, 1, "complete", None), (3, 2, "complete", 0.0)
    ]
    done = run((1, 1, 2.0), (3, 2, 9.0), (2, 0, 6.0))
    assert [r for r in done if r[0] == 1] == [(1, 0, "complete", -1.0), (1, 1, "complete", 0.0), (1, 2, "complete", 1.0)]
    assert (3, 2, "late", None) in done and (2, 0, "repeated", None) in done and len(done) == 8


def test_waiting_ends_and_marks_are_forgotten(run):
    run((2, 0, 5.0), wait=timedelta(0), remember=timedelta(0), skew=timedelta(0))
    done = run((7, 0, 1.0), wait=timedelta(0), remember=timedelta(0), skew=timedelta(0))
    assert (2, 0, "incomplete", None) in done
    for prompt in (8, 9):  # time passes with micro-batches
        run((prompt, 0, 1.0), wait=timedelta(0), remember=timedelta(0), skew=timedelta(0))
    done = run((2, 1, 1.0), wait=timedelta(0), remember=timedelta(0), skew=timedelta(0))
    assert (2, 1, "late", None) not in done  # a new group by now


@pytest.mark.parametrize("normalize", [True, False])
def test_the_stream_agrees_with_the_batch(spark, tmp_path, normalize):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.expr("event_id div 8").alias("prompt"), (F.col("event_id") % 8).cast("int").alias("no"), F.col("value").alias("score")
    )
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    events.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = complete_groups(stream, "prompt", "no", "score", 8, normalize=normalize)
    append_stream(out, target, checkpoint, by=("status",)).awaitTermination()
    rows = spark.read.parquet(target)
    key = lambda df: sorted((r.prompt, r.no, round(r.advantage, 6)) for r in df.collect())
    assert key(rows.where("status = 'complete'")) == key(group_advantage(events, "prompt", normalize=normalize))
    assert rows.where("status <> 'complete'").isEmpty()


class Messages:
    """A state that counts its calls, each of which is a message between Python and the JVM."""

    def __init__(self):
        self.n, self.kept = 0, {}

    def __getattr__(self, name):
        def call(*args):
            if name.startswith("get") and name != "get":
                return self
            self.n += 1
            return {"containsKey": False, "exists": False, "listTimers": (), "iterator": ()}.get(name)

        return call


def test_rows_of_a_micro_batch_share_their_messages():
    state = Messages()
    done = GroupCompletion(8, 1000, 1000, True)
    done.init(state)
    at = datetime(2024, 1, 1)
    rows = [Row(group_key=g, member=m, score=float(m), at=at) for g in range(10) for m in range(8)]
    assert len(list(done.handleInputRows((0,), iter(rows), None))) == 80
    assert state.n <= 4


def test_groups_of_one_bucket_keep_apart(run):
    one = {"buckets": 1, "wait": timedelta(0), "remember": timedelta(0), "skew": timedelta(0)}
    assert run((1, 0, 1.0), (2, 0, 5.0), (1, 1, 2.0), (1, 2, 3.0), buckets=1) == [
        (1, 0, "complete", -1.0), (1, 1, "complete", 0.0), (1, 2, "complete", 1.0)
    ]
    done = run((2, 1, 4.0), (2, 2, 3.0), (1, 0, 9.0), (3, 0, 1.0), buckets=1)
    assert [r[2] for r in done if r[0] == 2] == ["complete"] * 3 and (1, 0, "late", None) in done
    run((4, 0, 1.0), **one)
    done = run((5, 0, 1.0), **one)
    assert (4, 0, "incomplete", None) in done and [r for r in done if r[0] == 3] == []  # 3 waits for an hour


@pytest.mark.parametrize("kind", ["double", "binary", "string", "timestamp", "array<int>"])
def test_names_of_groups_of_any_kind(spark, tmp_path, kind):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    cast = "array(cast(name as int))" if kind == "array<int>" else "cast('NaN' as double) + name" if kind == "double" else (
        "cast(cast(name as string) as binary)" if kind == "binary" else f"cast(name as {kind})")
    rows = spark.range(4).selectExpr("id % 2 as name", "id as no", "double(id) as score").selectExpr(f"{cast} as name", "no", "score")
    rows.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = complete_groups(stream, "name", "no", "score", 4 if kind == "double" else 2, buckets=1)
    append_stream(out, target, checkpoint, by=("status",)).awaitTermination()
    assert sorted((r.no, r.status) for r in spark.read.parquet(target).collect()) == [(i, "complete") for i in range(4)]
