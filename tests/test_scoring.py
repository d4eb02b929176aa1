import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefloom.functions.tokens import WordTokenizer
from prefloom.operators import scoring as sc
from prefloom.operators.vocabulary import build_vocabulary, decode
from prefloom.plans.scoring import score_and_centre


def sum_scorer():
    # Made in a function, so that it reaches the tasks by value.
    return lambda: lambda tokens: tokens.map(lambda t: float(sum(t)))


def tokens(spark, n=50):
    return spark.range(n).select("id", F.array("id", F.lit(1).cast("bigint")).alias("tokens")).repartition(3)


def test_scores_and_centring(spark):
    rows = score_and_centre(tokens(spark), "tokens", sum_scorer()).collect()
    assert len(rows) == 50 and all(r.score == r.id + 1 for r in rows)
    assert sum(r.centred_score for r in rows) == pytest.approx(0)


def test_model_is_loaded_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/{uuid.uuid4()}", "w").close()
        return lambda tokens: pd.Series([0.0] * len(tokens))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        sc.score_batches(tokens(spark).coalesce(1), "tokens", make).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 1


def test_generation_gives_several_rows_per_prompt(spark):
    def make():
        def generate(prompts):
            assert 0 < len(prompts) <= 4
            return [[([int(p) for p in prompt], [-0.5] * len(prompt))] * (int(prompt[0]) % 3) for prompt in prompts]

        return generate

    rows = sc.generate_batches(tokens(spark, 6), "id", "tokens", make, batch_size=4).collect()
    assert sorted((r.id, r.response_no) for r in rows) == [(1, 0), (2, 0), (2, 1), (4, 0), (5, 0), (5, 1)]
    assert all(r.response_tokens == [r.id, 1] and r.log_probs == [-0.5, -0.5] for r in rows)


def test_map_rows(spark):
    rows = sc.map_rows(spark.range(5), lambda row: {"twice": row["id"] * 2}, "twice bigint").collect()
    assert sorted(r.twice for r in rows) == [0, 2, 4, 6, 8]


def test_map_rows_sees_values_as_they_are(spark):
    df = spark.createDataFrame([(9007199254740993,), (None,)], "id bigint")
    rows = sc.map_rows(df, lambda row: {"seen": repr(row["id"]), "id": row["id"]}, "seen string, id bigint").collect()
    assert {tuple(r) for r in rows} == {("9007199254740993", 9007199254740993), ("None", None)}


@pytest.mark.parametrize("small_vocabulary", [0, 1, 2, 3, 1000])
def test_decode_is_alike_at_every_size(spark, small_vocabulary):
    big = 1 << 59
    rows = [("k", [1, big + 1, 5]), ("k", [5]), ("n", None), ("e", []), (None, [7, None, big + 1]), ("x", [None])]
    df = spark.createDataFrame(rows, "key string, tokens array<bigint>")
    words = spark.createDataFrame([(big + 1, "big"), (5, "five"), (1, "special"), (9, None)], "token_id bigint, token string")
    got = decode(df, "key", "tokens", words, small_vocabulary=small_vocabulary)
    want = [("k", "big five"), ("k", "five"), ("n", None), ("e", ""), (None, "big"), ("x", "")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_attach_and_unscored(spark):
    scores = spark.createDataFrame([(1, 0.5)], "id bigint, score double")
    assert {tuple(r) for r in sc.attach_scores(spark.range(3), scores, "id").collect()} == {(0, None), (1, 0.5), (2, None)}
    assert sorted(r.id for r in sc.unscored(spark.range(3), scores, "id").collect()) == [0, 2]


@pytest.mark.parametrize("small_vocabulary, min_hot_rows", [(1000, 10**6), (2, 10**6), (2, 5)])
def test_decode_by_lookup_and_by_join(spark, small_vocabulary, min_hot_rows):
    texts = {i: " ".join(["the"] * 10 + [f"w{i % 7}", "<|endoftext|>", "end"]) for i in range(40)} | {90: "", 91: "[PAD]"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    tokenizer = WordTokenizer()
    encoded = df.select("id", tokenizer.encode(F.col("text")).alias("tokens"))
    got = decode(encoded, "id", "tokens", build_vocabulary(df, "text"), small_vocabulary=small_vocabulary, min_hot_rows=min_hot_rows)
    want = {i: " ".join(w for w in t.split() if w not in ("<|endoftext|>", "[PAD]")) for i, t in texts.items()}
    assert {r.id: r.decoded for r in got.collect()} == want


def test_large_vocabularies_are_asked_once_a_block(spark):
    """Rows of one block send each of their ids once, however often their tokens repeat."""
    texts = spark.range(400).selectExpr("id", "repeat(concat('one two w', id % 3, ' '), 50) AS text")
    encoded = texts.select("id", WordTokenizer().encode(F.col("text")).alias("tokens"))
    got = decode(encoded, "id", "tokens", build_vocabulary(texts, "text"), small_vocabulary=0)
    assert {r.id: r.decoded for r in got.collect()} == {i: " ".join(f"one two w{i % 3}" for _ in range(50)) for i in range(400)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan
