from pyspark.sql import functions as F

from prefloom.functions.tokens import WordTokenizer
from prefloom.plans.examples import build_sft_examples
from prefloom.schemas import EOS_TEXT, PAD_TEXT, SftParams

COLUMNS = ["id", "subreddit", "title", "post", "summary"]


def build(spark, *rows, **params):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], COLUMNS)
    return build_sft_examples(df, SftParams(**params)).orderBy("id").collect()


def test_labels_hide_query_and_padding(spark):
    row = build(spark, ("s", "t", "some post", "a b"), budget=20, response_width=5, total_width=25)[0]
    n = row.query_token_length_without_padding
    tokens, labels = row.query_and_response_tokens, row.query_and_response_labels
    assert len(tokens) == len(labels) == 25
    assert labels[:n] == [-100] * n and labels[n : n + 3] == tokens[n : n + 3] and tokens[n + 2] == 1
    assert labels[n + 3 :] == [-100] * (25 - n - 3) and tokens[n + 3 :] == [0] * (25 - n - 3)
    assert tokens[:n] == row.query_tokens[-n:] and row.response == f" a b{EOS_TEXT}"


def test_exact_width_keeps_all_labels(spark):
    n = build(spark, ("s", "t", "p", "a"))[0].query_token_length_without_padding
    row = build(spark, ("s", "t", "p", "a"), budget=n, response_width=2, total_width=n + 2)[0]
    assert 0 not in row.query_and_response_tokens
    assert row.query_and_response_labels == [-100] * n + row.query_and_response_tokens[n:]


def test_long_response_loses_its_end_and_says_so(spark):
    rows = build(spark, ("s", "t", "p", "a b c d"), ("s", "t", "p", "a b"), response_width=3, total_width=30)
    assert [r.eos_kept for r in rows] == [False, True]
    assert [r.response_token_length for r in rows] == [5, 3]
    assert 1 not in rows[0].response_tokens and rows[1].response_tokens[-1] == 1


def test_over_budget_rows_are_kept_and_marked(spark):
    rows = build(spark, ("s", "one two three four", "", "a"), ("s", "t", "p", "a"), budget=8)
    assert [r.status for r in rows] == ["over_budget", "ok"]
    assert rows[0].query_tokens is None and rows[0].query_and_response_labels is None
    assert rows[0].response == f" a{EOS_TEXT}"


def test_special_texts_in_a_post_leave_the_query_text(spark):
    row = build(spark, ("s", "t", f"x{EOS_TEXT} y {PAD_TEXT}", "a"))[0]
    assert EOS_TEXT not in row.query and PAD_TEXT not in row.query
    tokenizer = WordTokenizer()
    joined = row.query.strip() + row.response
    ids = spark.createDataFrame([(joined,)], ["t"]).select(tokenizer.encode(F.col("t")).alias("i")).first().i
    assert row.query_and_response == joined and row.query_and_response_tokens[: len(ids)] == ids
    assert 1 in row.query_tokens


def test_joint_tokens_are_those_of_the_joint_text(spark):
    odd = ["\xa0x", "x\xa0", f"{EOS_TEXT}x", "x", "\x1cx y\x1f"]
    params = SftParams(budget=30, total_width=50, template="{title}\n{post}", cut_field="post")
    df = spark.createDataFrame([(str(i), "s", a, b, "sum") for i, (a, b) in enumerate((a, b) for a in odd for b in odd)], COLUMNS)
    rows = build_sft_examples(df, params).withColumn("again", WordTokenizer().encode(F.col("query_and_response"))).collect()
    assert len(rows) == 25
    assert all(r.query_and_response_tokens == (r.again + [0] * 50)[:50] for r in rows)


def test_one_pass_without_a_shuffle(spark):
    df = spark.createDataFrame([("1", "s", "t", "p", "a")], COLUMNS)
    plan = build_sft_examples(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
