import json

import pytest
from pyspark.sql import functions as F

from prefloom.schemas import SftParams
from prefloom.session import cut_lineage, scratch_path, shared_dir
from prefloom.sources import feedback
from prefloom.sources import tables as tb
from test_records import record


def splits(spark):
    return spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("validation"))


def test_versions_and_split_pruning(spark, tmp_path):
    path = tb.write_versioned(splits(spark), str(tmp_path / "set"), "20240102_030405")
    assert path.endswith("set_20240102_030405")
    part = tb.read_table(spark, path, "validation")
    assert sorted(r.id for r in part.collect()) == [7, 8, 9]
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()
    assert tb.read_table(spark, path).count() == 10
    with pytest.raises(Exception, match="already exists"):
        tb.write_versioned(splits(spark), str(tmp_path / "set"), "20240102_030405")


def test_manifest_follows_the_schema(spark, tmp_path):
    df = tb.with_comments(splits(spark), {"id": "row number"})
    path = tb.write_manifest(df, str(tmp_path / "set"), SftParams(), "source table")
    (line,) = [json.loads(x) for x in spark.read.text(path).toPandas()["value"]]
    assert line["source"] == "source table"
    assert json.loads(line["columns"])[0] == {"name": "id", "type": "bigint", "comment": "row number"}
    assert json.loads(line["params"])["total_width"] == 575
    assert line["splits"] == [{"split": "train", "n_rows": 7}, {"split": "validation", "n_rows": 3}]
    with pytest.raises(ValueError, match="no such columns"):
        tb.with_comments(df, {"missing": "x"})


def test_comments_survive_a_write(spark, tmp_path):
    tb.with_comments(splits(spark), {"id": "row number"}).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).schema["id"].metadata["comment"] == "row number"


def test_scores_reports_and_metrics(spark, tmp_path):
    path = tb.write_with_scores(spark.range(3), str(tmp_path / "set"), F.col("id") * 0.5)
    assert path.endswith("set_with_rewards")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(0, 0.0), (1, 0.5), (2, 1.0)]
    report = spark.createDataFrame([(3, 1.23456, "two\nlines")], "step int, reward double, text string")
    for _ in range(2):
        tb.write_text_report(report, str(tmp_path / "report"), "step", "reward", "text")
    (folder,) = [p for p in (tmp_path / "report").iterdir() if p.is_dir()]
    texts = [p.read_text() for p in folder.glob("part-*")]
    assert folder.name == "step=3" and texts == ["Reward: 1.2346\ntwo\nlines\n" + "=" * 100 + "\n"] * 2
    for step in (1, 2):
        tb.append_metrics(spark.createDataFrame([("r", step, 0.5)], "run string, step int, loss double"), str(tmp_path / "m"), "loss")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [("r", 1, "loss", 0.5), ("r", 2, "loss", 0.5)]


def test_small_inputs_are_spread(spark):
    assert tb.spread_small(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tb.spread_small(spark.range(10).coalesce(1), small_bytes=1).rdd.getNumPartitions() == 1


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/prefloom-x-")
    cut = cut_lineage(spark.range(4))
    assert cut.count() == 4 and "FileScan" in cut._jdf.queryExecution().executedPlan().toString()


def test_lines_are_records_or_have_a_reason(spark, tmp_path):
    good = record()
    bad = {
        "not JSON": "{",
        "not an object": "[1]",
        "does not fit: info, choice": json.dumps({**good, "choice": "x", "info": 5}),
        "does not fit": json.dumps({**good, "extra": {"confidence": "high"}}),
        "no choice": json.dumps({**good, "choice": None}),
        "fewer than two summaries": json.dumps({**good, "summaries": good["summaries"][:1]}),
        "no such summary": json.dumps({**good, "choice": 2}),
    }
    path = tmp_path / "lines.json"
    path.write_text("\n".join([json.dumps(good), "", "  ", *bad.values(), json.dumps(good)]) + "\n")
    checked = feedback.read_checked(spark, "comparisons", str(path))
    assert {r.reason: r.line for r in feedback.set_aside(checked).collect()} == bad
    rows = feedback.good_records(checked)
    assert rows.collect() == feedback.read_comparisons(spark, str(path)).limit(0).union(rows).collect() and rows.count() == 2
    assert rows.schema == feedback.KINDS["comparisons"].schema and checked.count() == 2 + len(bad)
    axis = feedback.read_checked(spark, "axis", str(path))
    assert axis.where("reason IS NULL").count() + feedback.set_aside(axis).count() == axis.count()


def test_files_of_batches_that_are_left_out_are_not_read(spark, tmp_path):
    for name, text in (("batch3", json.dumps(record())), ("cnndm0", "no record at all"), ("batch4", json.dumps(record()))):
        (tmp_path / f"{name}.json").write_text(text + "\n")
    rows = feedback.read_feedback(spark, "comparisons", str(tmp_path), without=["cnndm0", "cnndm2"])
    assert len(rows.collect()) == 2
    plan = rows._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numFiles").value() == 2
    assert feedback.read_checked(spark, "comparisons", str(tmp_path)).count() == 3
