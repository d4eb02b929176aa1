import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators import ordering as od
from prefloom.operators.metrics import best_so_far, is_cadence_step, long_metrics


def shuffled(ids, seed, epoch=0):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(1)
    ids = rng.sample(range(-(10**6), 10**6), 500) + [2**62, -(2**62)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(partitions)
    ordered = {r.id: r.position for r in od.ordered_positions(df, "id", rows_per_bucket=20).collect()}
    assert ordered == {i: p for p, i in enumerate(sorted(ids))}
    for digits in (1, 4):
        random_order = {r.id: r.position for r in od.shuffled_positions(df, "id", 9, 2, hash_digits=digits).collect()}
        assert random_order == {i: p for p, i in enumerate(shuffled(ids, 9, 2))}
    assert [r.id for r in od.seeded_shuffle(df, "id", 9, 2).collect()] == shuffled(ids, 9, 2)


def test_epochs_give_other_orders(spark):
    df = spark.range(50)
    first, second = ([r.id for r in od.seeded_shuffle(df, "id", 9, e).collect()] for e in (0, 1))
    assert first != second and sorted(first) == sorted(second)


def test_times_order_and_texts_do_not(spark):
    df = spark.sql("select id, timestamp_seconds(1000 - id) as ts, cast(id as string) as name from range(100)")
    rows = od.ordered_positions(df, "ts").collect()
    assert all(r.position == 99 - r.id for r in rows)
    with pytest.raises(TypeError):
        od.ordered_positions(df, "name")


def test_short_last_batch_and_groups(spark):
    rows = od.assign_batches(spark.range(17), 8, "id").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [(r.batch_id, r["count"]) for r in rows] == [(0, 8), (1, 8), (2, 1)]
    groups = od.assign_groups(spark.range(17), 8, "id").collect()
    assert all(r.group_id == r.id // 8 for r in groups)
    with pytest.raises(ValueError):
        od.assign_batches(spark.range(3), 0, "id")


def test_minibatches_cover_every_row_in_every_pass(spark):
    df = spark.range(100).withColumn("step", F.col("id") % 3)
    rows = od.assign_minibatches(df, "id", updates=2, mini_size=10, micro_size=4, seed=1, by=["step"]).collect()
    assert len(rows) == 200
    for step in range(3):
        ids = [i for i in range(100) if i % 3 == step]
        for update in range(2):
            want = {i: p for p, i in enumerate(shuffled(ids, 1, update))}
            part = [r for r in rows if r.step == step and r.update == update]
            assert {r.id: r.position for r in part} == want
            assert all((r.mini_batch, r.micro_batch) == (r.position // 10, r.position % 10 // 4) for r in part)


def test_null_groups_are_kept(spark):
    df = spark.range(30).withColumn("step", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    rows = od.assign_minibatches(df, "id", updates=2, mini_size=4, micro_size=2, seed=1, by=["step"]).collect()
    assert len(rows) == 60
    assert sorted(r.position for r in rows if r.step is None and r.update == 0) == list(range(10))


def test_take_first(spark, monkeypatch):
    df = spark.range(100).repartition(5)
    assert od.take_first(df, None, "id").count() == 100
    assert sorted(r.id for r in od.take_first(df, 7, "id").collect()) == list(range(7))
    monkeypatch.setattr(od, "SMALL_LIMIT", 5)
    assert sorted(r.id for r in od.take_first(df, 7, "id").collect()) == list(range(7))


def test_empty_input(spark):
    empty = spark.range(0)
    assert od.ordered_positions(empty, "id").count() == 0
    assert od.assign_batches(empty, 4, "id", seed=1).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [10, 100_000])
def test_best_so_far(spark, rows_per_bucket):
    rng = random.Random(4)
    rows = [(run, step, rng.choice([None, float("nan"), float("inf"), rng.random() + 10 / (step + 1)])) for run in ("a", "b", None) for step in range(300)]
    want = []
    for run in ("a", "b", None):
        best = float("inf")
        for _, step, loss in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if loss is not None and loss < best:
                best = loss
                want.append((run, step))
    df = spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(7)
    got = best_so_far(df, "loss", rows_per_bucket=rows_per_bucket).collect()
    assert sorted(((r.run, r.step) for r in got), key=str) == sorted(want, key=str)


def test_cadence_and_long_metrics(spark):
    df = spark.range(10)
    assert [r.id for r in df.where(is_cadence_step(F.col("id"), 4)).orderBy("id").collect()] == [3, 7]
    assert [r.id for r in df.where(is_cadence_step(F.col("id"), 4, 0, last_step=9)).orderBy("id").collect()] == [0, 4, 8, 9]
    wide = spark.createDataFrame([("r", 1, 0.5, 2)], "run string, step bigint, loss double, n int")
    assert sorted(map(tuple, long_metrics(wide, ["loss", "n"]).collect())) == [("r", 1, "loss", 0.5), ("r", 1, "n", 2.0)]


@pytest.mark.parametrize("key", ["id", "name", "at"])
@pytest.mark.parametrize("n", [0, 3, 5, 6, 40, 299, 300, 301])
def test_take_first_is_alike_at_every_size(spark, monkeypatch, key, n):
    monkeypatch.setattr(od, "SMALL_LIMIT", 5)
    monkeypatch.setattr(od, "FIRST_SAMPLE", 60)
    df = spark.range(300).repartition(5).selectExpr("id", "md5(string(id)) name", "timestamp_seconds(id * 7919 % 1000) at")
    df = df.selectExpr("id", "if(id = 77, null, name) name", "at")
    assert od.take_first(df, n, key).collect() == df.orderBy(key).limit(n).collect()
