from pyspark.sql import functions as F

import brute
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = stage("quality rules")(spark, docs, FOLDER)
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and 0 < len(rows) < docs.count()
    order = sorted(rows)
    first, _ = brute.classes([rows[i] for i in order])
    single = stage("n-gram Jaccard join")(spark, kept, FOLDER)
    left = {r.doc_id: r.text for r in single.collect()}
    assert sorted(left) == [i for n, i in enumerate(order) if first[n] == n]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {i: brute.contamination(t, items) for i, t in left.items()}
    clean = stage("benchmark decontamination")(spark, single, FOLDER)
    assert {r.doc_id for r in clean.collect()} == {i for i, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n)}


def test_run_packs_what_the_stages_keep(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    pieces = packed.groupBy("doc_id").agg(F.max("piece").alias("last"), F.count("*").alias("n"))
    assert pieces.where("n != last + 1").count() == 0 and pieces.count() > 50


def test_stages_take_empty_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "w " * 30, None, "b", 60)]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    for n in (4, 0):
        docs = spark.createDataFrame(rows[:n], schema)
        for name, run in corpus_pipeline.STAGES:
            out = run(spark, docs, FOLDER)
            assert out.count() == {"quality rules": 0}.get(name, n)
