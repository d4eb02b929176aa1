from pyspark.sql import functions as F

from prefloom.catalog.subword_queries import TOKENIZER
from prefloom.functions.text import format_response, join_query_response, lstrip
from prefloom.plans.examples import build_sft_examples
from prefloom.schemas import SftParams

POSTS = [None, "", "the [PAD] post<|endoftext|> ", "line\n" * 300, "  the end \x1f", "x" * 500, "in\nand the\n[PAD]"]


def _posts(spark):
    rows = [(i, " sub" * (i % 90), POSTS[i % 3], POSTS[i % 7], POSTS[(i + 3) % 7]) for i in range(91)]
    return spark.createDataFrame(rows, "id int, subreddit string, title string, post string, summary string")


def test_one_worker_a_task_makes_the_examples(spark):
    plan = build_sft_examples(_posts(spark), SftParams(budget=64, response_width=20, total_width=84), TOKENIZER)
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_examples_are_those_of_the_single_steps(spark):
    params = SftParams(template="\n[PAD] r/{subreddit} {title}\n{post}\n\nTL;DR: <|endoftext|>", budget=64, response_width=20, total_width=84)
    posts = _posts(spark)
    got = {r.id: r for r in build_sft_examples(posts, params, TOKENIZER).collect()}
    fields = {name: F.col(name) for name in ("subreddit", "title", "post")}
    steps = posts.withColumn("f", TOKENIZER.fit_prompt_ids(params.template, fields, 64))
    response = format_response(F.col("summary"), leading_blank=True, eos_text=TOKENIZER.eos_text)
    steps = steps.withColumn("response", response).withColumn("query", lstrip(TOKENIZER.drop_specials(F.col("f.prompt"))))
    steps = steps.withColumn("joint", TOKENIZER.encode(join_query_response(F.col("query"), F.col("response"))))
    found = steps.withColumn("own", TOKENIZER.encode(F.col("response"))).collect()
    pad, fitting = TOKENIZER.pad_id, 0
    for row in found:
        example = got[row.id]
        assert example.query == row.query and example.status == ("ok" if row.f else "over_budget")
        assert example.response_tokens == (row.own + [pad] * 20)[:20] and example.response_token_length == len(row.own)
        assert example.query_and_response_tokens == (None if row.joint is None else (row.joint + [pad] * 84)[:84])
        assert example.query_token_length_without_padding == (None if row.f is None else len(row.f.ids))
        fitting += row.f is not None
    assert 0 < fitting < len(found)
