"""User functions, whole jobs and streams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.order_queries import GROUPED
from prefloom.catalog.record_queries import _PICKED, ROUTED, comparison_files
from prefloom.catalog.registry import query
from prefloom.catalog.views import TOKENIZER, joined, rounded, sql_fill, sql_fix_width, sql_ids, sql_joined, sql_round, with_views
from prefloom.operators.scoring import generate_batches, map_rows, score_batches
from prefloom.operators.table_functions import register_generator
from prefloom.plans.examples import build_preference_pairs, build_sft_examples, prepare_comparisons
from prefloom.plans.evaluation import rollout_validation, sft_eval
from prefloom.plans.rollouts import audit_rollouts
from prefloom.plans.scoring import score_and_centre
from prefloom.schemas import IGNORED_LABEL
from prefloom.session import scratch_path
from prefloom.sources.feedback import good_records, read_checked, read_comparisons, set_aside
from prefloom.sources.tables import spread_small
from prefloom.streaming import jobs as st
from prefloom.streaming.groups import complete_groups


def stand_ins():
    """Stand-ins for the functions a user brings. They are made inside a function, so that they
    travel to the tasks by value and executors need not have this package.

    ``count_words`` works on rows, ``make_scorer`` on token arrays (the mean of the ids modulo
    1000, in thousandths), ``make_generator`` echoes a prompt twice, the second time shifted by
    one.
    """

    def count_words(row: dict) -> dict:
        words = re.findall(r"\S+", row["text"], re.ASCII)
        return {"doc_id": row["doc_id"], "n_words": len(words), "longest": max(map(len, words), default=0)}

    def make_scorer():
        def score(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda ids: float(np.mean(np.asarray(ids) % 1000)) / 1000 if len(ids) else 0.0)

        return score

    def make_generator():
        def generate(prompts):
            arrays = [np.asarray(p, dtype="int64") for p in prompts]
            return [[((a + s).tolist(), (-((a + s) % 10) / 10).tolist()) for s in (0, 1)] for a in arrays]

        return generate

    return count_words, make_scorer, make_generator


COUNT_WORDS, MAKE_SCORER, MAKE_GENERATOR = stand_ins()

SCORE = "coalesce(list_avg(list_transform(tokens, lambda t: t % 1000)) / 1000, 0)"


def encoded_posts(spark, d):
    return v.posts(spark, d).select("id", TOKENIZER.encode(F.col("post")).alias("tokens"))


@query(
    "map_rows",
    rf"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, coalesce(list_max(list_transform(regexp_extract_all(text, '\S+'), lambda w: len(w))), 0) AS longest FROM documents",
)
def map_rows_query(spark, d):
    return map_rows(v.table(spark, d, "documents").select("doc_id", "text"), COUNT_WORDS, "doc_id bigint, n_words bigint, longest bigint")


@query(
    "score_batches",
    with_views(f", t AS (SELECT id, {sql_ids('post')} AS tokens FROM v_posts) SELECT id, {sql_round(SCORE)} AS score FROM t", "v_posts"),
)
def score_batches_query(spark, d):
    scored = score_batches(encoded_posts(spark, d), "tokens", MAKE_SCORER)
    return scored.select("id", rounded("score").alias("score"))


_GENERATED = with_views(
    f", t AS (SELECT id, {sql_ids('post')} AS tokens FROM v_posts), r AS (SELECT id, s::INT AS response_no, list_transform(tokens, lambda t: t + s) AS tokens FROM t CROSS JOIN range(2) AS x(s)) "
    f"SELECT id, response_no, {sql_joined('tokens')} AS response_tokens, "
    f"{sql_round('coalesce(list_sum(list_transform(tokens, lambda t: -(t % 10) / 10.0::DOUBLE)), 0)')} AS logp FROM r",
    "v_posts",
)


@query("generate_batches", _GENERATED)
def generate_batches_query(spark, d):
    rows = generate_batches(encoded_posts(spark, d), "id", "tokens", MAKE_GENERATOR)
    logp = F.aggregate("log_probs", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "response_no", joined("response_tokens").alias("response_tokens"), rounded(logp).alias("logp"))


@query("generate_table_function", _GENERATED)
def generate_table_function_query(spark, d):
    """The same generation, called from SQL."""
    register_generator(spark, "generate_responses", MAKE_GENERATOR)
    rows = spark.sql("SELECT * FROM generate_responses(TABLE({posts}), 'id', 'tokens')", posts=encoded_posts(spark, d))
    logp = F.aggregate("log_probs", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "response_no", joined("response_tokens").alias("response_tokens"), rounded(logp).alias("logp"))


PAD_LEFT = "CASE WHEN q IS NOT NULL THEN list_concat(" + sql_fill("0", "512 - len(q)") + ", q) END"


@query(
    "build_sft_examples",
    with_views(
        f", {v.sql_fitted('v_posts', 'id, summary')}, "
        f"q0 AS (SELECT id, prompt, {v.sql_lstrip('prompt')} AS query, ' ' || summary || '<|endoftext|>' AS response, {sql_ids('prompt')} AS q FROM fitted), "
        f"q1 AS (SELECT *, {v.sql_strip('query')} || response AS whole, {sql_ids('response')} AS r FROM q0), "
        f"q2 AS (SELECT *, {sql_ids("whole")} AS b FROM q1), "
        f"q3 AS (SELECT *, {sql_fix_width('b', 575)} AS t FROM q2) "
        "SELECT id, CASE WHEN prompt IS NULL THEN 'over_budget' ELSE 'ok' END AS status, coalesce(query, '') AS query, "
        f"{sql_joined(PAD_LEFT)} AS query_tokens, coalesce(len(q), -1)::INT AS query_token_length_without_padding, response, "
        f"{sql_joined(sql_fix_width('r', 63))} AS response_tokens, len(r)::INT AS response_token_length, coalesce(whole, '') AS query_and_response, "
        f"{sql_joined('t')} AS query_and_response_tokens, "
        f"{sql_joined('list_transform(t, lambda x, i: CASE WHEN i <= len(q) OR x = 0 THEN -100 ELSE x END)')} AS query_and_response_labels, "
        "len(r) <= 63 AS eos_kept FROM q3",
        "v_posts",
    ),
)
def sft_query(spark, d):
    examples = build_sft_examples(v.posts(spark, d))
    return examples.select(
        "id",
        "status",
        F.coalesce("query", F.lit("")).alias("query"),
        joined("query_tokens").alias("query_tokens"),
        F.coalesce("query_token_length_without_padding", F.lit(-1)).alias("query_token_length_without_padding"),
        "response",
        joined("response_tokens").alias("response_tokens"),
        "response_token_length",
        F.coalesce("query_and_response", F.lit("")).alias("query_and_response"),
        joined("query_and_response_tokens").alias("query_and_response_tokens"),
        joined("query_and_response_labels").alias("query_and_response_labels"),
        "eos_kept",
    )


@query(
    "build_preference_pairs",
    with_views(
        f", src AS (SELECT id || ':' || worker AS id, subreddit, title, post, {ROUTED} AS split, {_PICKED} FROM v_comparisons "
        "WHERE split = 'train' OR batch <> 'cnndm0'), "
        f"{v.sql_fitted('src', 'id, split, chosen, rejected')}, "
        f"q0 AS (SELECT id, split, prompt, {v.sql_lstrip('prompt')} AS query, chosen || '<|endoftext|>' AS cr, rejected || '<|endoftext|>' AS rr, {sql_ids('prompt')} AS q FROM fitted), "
        f"q1 AS (SELECT *, {v.sql_strip('query')} || cr AS qc, {v.sql_strip('query')} || rr AS qr FROM q0) "
        "SELECT id, split, CASE WHEN prompt IS NULL THEN 'over_budget' ELSE 'ok' END AS status, coalesce(query, '') AS query, "
        f"{sql_joined(PAD_LEFT)} AS query_tokens, coalesce(len(q), -1)::INT AS query_token_length_without_padding, "
        f"cr AS chosen_response, {sql_joined(sql_fix_width(sql_ids('cr'), 133))} AS chosen_response_tokens, "
        f"rr AS rejected_response, {sql_joined(sql_fix_width(sql_ids('rr'), 133))} AS rejected_response_tokens, "
        f"coalesce(qc, '') AS query_and_chosen_response, {sql_joined(sql_fix_width(sql_ids('qc'), 645))} AS query_and_chosen_response_tokens, "
        f"coalesce(qr, '') AS query_and_rejected_response, {sql_joined(sql_fix_width(sql_ids('qr'), 645))} AS query_and_rejected_response_tokens FROM q1",
        "v_comparisons",
    ),
)
def pairs_query(spark, d):
    rows = prepare_comparisons(v.comparisons(spark, d)).withColumn("id", F.concat_ws(":", "info.id", "worker"))
    pairs = build_preference_pairs(spread_small(rows), keys=("id", "split"))
    texts = ("query", "query_and_chosen_response", "query_and_rejected_response")
    for name in pairs.columns:
        if name.endswith("_tokens"):
            pairs = pairs.withColumn(name, joined(name))
        elif name in texts:
            pairs = pairs.withColumn(name, F.coalesce(name, F.lit("")))
    n = "query_token_length_without_padding"
    return pairs.withColumn(n, F.coalesce(n, F.lit(-1)))


@query(
    "prepare_comparisons",
    with_views(f" SELECT id, worker, {ROUTED} AS split, batch, choice FROM v_comparisons WHERE split = 'train' OR batch <> 'cnndm0'", "v_comparisons"),
)
def prepare_comparisons_query(spark, d):
    rows = prepare_comparisons(read_comparisons(spark, comparison_files(spark, d)))
    return rows.select("info.id", "worker", "split", "batch", "choice")


@query(
    "score_and_centre",
    with_views(
        f", t AS (SELECT id, {sql_ids('post')} AS tokens FROM v_posts), s AS (SELECT id, {SCORE} AS score FROM t) "
        f"SELECT id, {sql_round('score')} AS score, {sql_round('score - (SELECT avg(score) FROM s)')} AS centred_score FROM s",
        "v_posts",
    ),
)
def score_and_centre_query(spark, d):
    out = score_and_centre(encoded_posts(spark, d), "tokens", MAKE_SCORER)
    return out.select("id", rounded("score").alias("score"), rounded("centred_score").alias("centred_score"))


@query(
    "score_and_centre_stored",
    with_views(
        f", t AS (SELECT id, {sql_ids('post')} AS tokens FROM v_posts), s AS (SELECT id, {SCORE} AS score FROM t) "
        f"SELECT id, {sql_round('score')} AS stored_score, {sql_round('score - (SELECT avg(score) FROM s)')} AS centred_score FROM s",
        "v_posts",
    ),
)
def score_and_centre_stored_query(spark, d):
    """The scores come from the stored table, beside the job's result."""
    path = scratch_path(spark, "posts")
    out = score_and_centre(encoded_posts(spark, d), "tokens", MAKE_SCORER, path)
    stored = spark.read.parquet(f"{path}_with_rewards").select("id", rounded("score").alias("stored_score"))
    return stored.join(out.select("id", rounded("centred_score").alias("centred_score")), "id")


@query(
    "sft_eval",
    with_views(
        ", b AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS batch FROM v_aligned), "
        "l AS (SELECT batch, avg(-lp) AS loss FROM v_tokens JOIN b USING (vec_id) WHERE m AND pos > 0 GROUP BY batch) "
        f"SELECT {sql_round('avg(loss)')} AS eval_loss, count(*) AS batches, (SELECT count(DISTINCT batch) FROM b) - count(*) AS unlabelled FROM l",
        "v_tokens",
    ),
)
def sft_eval_query(spark, d):
    labels = F.transform("mask", lambda m: F.when(m, F.lit(7)).otherwise(F.lit(IGNORED_LABEL)).cast("bigint"))
    logged = v.token_log(spark, d).select("vec_id", "log_probs", labels.alias("labels"))
    return sft_eval(logged, "vec_id", 8).withColumn("eval_loss", rounded("eval_loss"))


@query(
    "rollout_validation",
    with_views(
        f" SELECT event_id // 1000 AS step, {sql_round('avg(reward)')} AS mean_reward, count(*) AS n, 3 * count(*) AS report_lines, "
        "count(*) AS reported_texts FROM v_rollouts GROUP BY event_id // 1000",
        "v_rollouts",
    ),
)
def rollout_validation_query(spark, d):
    report = scratch_path(spark, "validation")
    text = F.concat(F.lit("text of "), F.col("event_type"))
    rows = v.rollouts(spark, d).withColumn("step", F.expr("event_id div 1000"))
    means = rollout_validation(rows, text, report, pad_id=0, eos_id=1)
    lines = spark.read.schema("value string, step bigint").text(report).groupBy("step").agg(
        F.count("*").alias("report_lines"), F.count_if(F.startswith("value", F.lit("text of "))).alias("reported_texts")
    )
    return means.join(lines, "step").withColumn("mean_reward", rounded("mean_reward"))


@query(
    "audit_rollouts",
    with_views(
        ", g AS (SELECT *, coalesce((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-7), 0) AS adv FROM v_rollouts WINDOW w AS (PARTITION BY prompt_id)) "
        f"SELECT event_id, prompt_id, response_no, {sql_round('reward')} AS reward, n_tokens = 0 AS empty_response, {sql_round('adv')} AS advantage, "
        f"{sql_round('adv * n_tokens')} AS advantage_total FROM g",
        "v_rollouts",
    ),
)
def audit_rollouts_query(spark, d):
    audited = audit_rollouts(v.rollouts(spark, d).drop("score"), pad_id=0, eos_id=1, group_size=8)
    return audited.select(
        "event_id",
        "prompt_id",
        "response_no",
        rounded("score").alias("reward"),
        "empty_response",
        rounded("advantage").alias("advantage"),
        rounded(F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x)).alias("advantage_total"),
    )


@query("stream_mean_score", f"SELECT event_type, {sql_round('avg(value)')} AS mean_score, count(value) AS n FROM events GROUP BY event_type")
def stream_mean_score_query(spark, d):
    source = scratch_path(spark, "stream-in")
    rows = v.table(spark, d, "events").select("event_type", "value")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    target = scratch_path(spark, "means")
    st.update_means(st.running_means(stream, "event_type", "value"), target, f"{target}-checkpoint").awaitTermination()
    return st.latest_means(spark, target, "event_type").withColumn("mean_score", rounded("mean_score"))


@query(
    "stream_comparisons",
    with_views(f" SELECT id, worker, {ROUTED} AS split, {_PICKED} FROM v_comparisons WHERE split = 'train' OR batch <> 'cnndm0'", "v_comparisons"),
)
def stream_comparisons_query(spark, d):
    source = scratch_path(spark, "stream-in")
    v.comparisons(spark, d).write.json(source)
    target = scratch_path(spark, "stream-out")
    stream = st.stream_comparisons(spark, source, files_per_trigger=2)
    flat = stream.select("info.id", "worker", "split", "chosen", "rejected")
    st.append_stream(flat, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.schema(flat.schema).parquet(target)


@query("stream_group_advantage", with_views(f", g AS ({GROUPED}) SELECT event_id, 'complete' AS status, {sql_round('advantage')} AS advantage FROM g", "v_rollouts"))
def stream_group_advantage_query(spark, d):
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "groups")
    rows = v.rollouts(spark, d).select("event_id", "prompt_id", "score")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    done = complete_groups(stream, "prompt_id", "event_id", "score", 8)
    st.append_stream(done, target, f"{target}-checkpoint", by=("status",)).awaitTermination()
    return spark.read.schema(done.schema).parquet(target).select("event_id", "status", rounded("advantage").alias("advantage"))


# Broken lines made of document ids, and what is wrong with them.
BROKEN = (
    ('{"choice": 1, "batch": "b', '"', "not JSON"),
    ('["', '"]', "not an object"),
    ('{"choice": "first", "batch": "b', '"}', "does not fit: choice"),
    ('{"summaries": [{"text": "a"}, {"text": "b"}], "worker": "w', '"}', "no choice"),
    ('{"choice": 1, "summaries": [{"text": "a"}], "worker": "w', '"}', "fewer than two summaries"),
    ('{"choice": 2, "summaries": [{"text": "a"}, {"text": "b"}], "worker": "w', '"}', "no such summary"),
)
_BROKEN_SQL = " ".join(f"WHEN {i} THEN '{a}' || doc_id || '{b}'" for i, (a, b, _) in enumerate(BROKEN))
_REASON_SQL = " ".join(f"WHEN {i} THEN '{r}'" for i, (_, _, r) in enumerate(BROKEN))


def _with_broken_lines(spark, d) -> str:
    """The comparison records as lines, with a broken one for each document."""
    path = comparison_files(spark, d)
    which = F.col("doc_id") % len(BROKEN)
    line = F.lit(None).cast("string")
    for i, (before, after, _) in enumerate(BROKEN):
        line = F.when(which == i, F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))).otherwise(line)
    v.table(spark, d, "documents").select(line.alias("value")).write.mode("append").text(path)
    return path


CHECKED = with_views(
    f" SELECT id AS line, 'good' AS reason FROM v_comparisons UNION ALL "
    f"SELECT CASE doc_id % {len(BROKEN)} {_BROKEN_SQL} END, CASE doc_id % {len(BROKEN)} {_REASON_SQL} END FROM documents",
    "v_comparisons",
)


@query("read_checked", CHECKED)
def read_checked_query(spark, d):
    checked = read_checked(spark, "comparisons", _with_broken_lines(spark, d))
    good = good_records(checked).select(F.col("info.id").alias("line"), F.lit("good").alias("reason"))
    return good.unionByName(set_aside(checked))


@query("stream_checked", CHECKED)
def stream_checked_query(spark, d):
    target, aside = scratch_path(spark, "good"), scratch_path(spark, "aside")
    checked = st.stream_checked(spark, "comparisons", _with_broken_lines(spark, d), files_per_trigger=4)
    st.append_checked(checked, target, aside, f"{target}-checkpoint").awaitTermination()
    good = spark.read.parquet(target).select(F.col("info.id").alias("line"), F.lit("good").alias("reason"))
    return good.unionByName(spark.read.parquet(aside).select("line", "reason"))
