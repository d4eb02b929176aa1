"""Prompts, tokens, labels and masks over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.registry import query
from prefloom.catalog.views import TOKENIZER, joined, rounded, sql_fix_width, sql_fill, sql_ids, sql_joined, sql_words, with_views
from prefloom.functions import sequences as seq
from prefloom.functions.text import format_prompt, format_response, join_query_response
from prefloom.operators.groups import fan_out
from prefloom.operators.vocabulary import build_vocabulary, decode
from prefloom.schemas import PROMPT_TEMPLATE
from prefloom.session import cut_lineage
from prefloom.sources.tables import spread_small


def _fields(*names: str):
    return {name: F.col(name) for name in names}


def _token_base(spark, d):
    """Token ids of whole texts, and of their first line as the query part."""
    base = v.posts(spark, d).select("id", TOKENIZER.encode(F.col("post")).alias("tokens"), TOKENIZER.encode(F.col("title")).alias("title_ids"))
    return base.select("id", "tokens", F.size("title_ids").alias("n_query"))


TOKEN_BASE = f", b AS (SELECT id, {sql_ids('post')} AS tokens, len({sql_words('title')}) AS n_query FROM v_posts)"


@query("format_prompt", with_views(f" SELECT id, {v.sql_prompt('post')} AS prompt FROM v_posts", "v_posts"))
def format_prompt_query(spark, d):
    prompt = format_prompt(PROMPT_TEMPLATE, _fields("subreddit", "title", "post"))
    return v.posts(spark, d).select("id", prompt.alias("prompt"))


@query(
    "format_response",
    with_views(
        " SELECT id, ' ' || post || '<|endoftext|>' AS sft_response, post || '<|endoftext|>' AS pair_response, "
        "' ' || summary || '<|endoftext|>' AS summary_response FROM v_posts",
        "v_posts",
    ),
)
def format_response_query(spark, d):
    return v.posts(spark, d).select(
        "id",
        format_response(F.col("post"), leading_blank=True).alias("sft_response"),
        format_response(F.col("post")).alias("pair_response"),
        format_response(F.col("summary"), leading_blank=True).alias("summary_response"),
    )


@query(
    "join_query_response",
    with_views(
        f" SELECT id, {v.sql_strip(v.NL + ' || post || ' + v.NL)} || ' ' || post AS query_and_response, "
        f"{v.sql_strip(v.NL + ' || post || ' + v.NL)} || ' ' || summary AS query_and_summary FROM v_posts",
        "v_posts",
    ),
)
def join_query_response_query(spark, d):
    padded = F.concat(F.lit("\n"), F.col("post"), F.lit("\n"))
    return v.posts(spark, d).select(
        "id",
        join_query_response(padded, F.concat(F.lit(" "), "post")).alias("query_and_response"),
        join_query_response(padded, F.concat(F.lit(" "), "summary")).alias("query_and_summary"),
    )


@query("encode", with_views(f" SELECT id, {sql_joined(sql_ids('post'))} AS tokens FROM v_posts", "v_posts"))
def encode_query(spark, d):
    return v.posts(spark, d).select("id", joined(TOKENIZER.encode(F.col("post"))).alias("tokens"))


@query(
    "truncate_to_budget",
    with_views(f", {v.sql_fitted('v_posts', 'id')} SELECT id, prompt, len({sql_words('prompt')})::INT AS n_tokens FROM fitted", "v_posts"),
)
def truncate_query(spark, d):
    prompt = TOKENIZER.fit_prompt(PROMPT_TEMPLATE, _fields("subreddit", "title", "post"), 512)
    fitted = v.posts(spark, d).select("id", prompt.alias("prompt"))
    return fitted.withColumn("n_tokens", TOKENIZER.count(F.col("prompt")))


@query(
    "pad",
    with_views(
        f"{TOKEN_BASE} SELECT id, {sql_joined('list_concat(' + sql_fill('0', '512 - len(tokens)') + ', tokens)')} AS left_padded, "
        f"{sql_joined('list_concat(tokens, ' + sql_fill('0', '512 - len(tokens)') + ')')} AS right_padded FROM b",
        "v_posts",
    ),
)
def pad_query(spark, d):
    tokens = F.col("tokens")
    return _token_base(spark, d).select(
        "id",
        joined(seq.pad(tokens, 512, 0, "left")).alias("left_padded"),
        joined(seq.pad(tokens, 512, 0, "right")).alias("right_padded"),
    )


@query("encode_fixed", with_views(f"{TOKEN_BASE} SELECT id, {sql_joined(sql_fix_width('tokens', 133))} AS tokens FROM b", "v_posts"))
def encode_fixed_query(spark, d):
    ids = TOKENIZER.encode(F.col("post"), 133)
    return v.posts(spark, d).select("id", joined(seq.fix_width(ids, 133, 0)).alias("tokens"))


@query("token_length", with_views(f" SELECT id, len({sql_words('post')})::INT AS n_tokens, len({sql_words('title')})::INT AS n_title FROM v_posts", "v_posts"))
def token_length_query(spark, d):
    return v.posts(spark, d).select(
        "id", TOKENIZER.count(F.col("post")).alias("n_tokens"), seq.token_length(TOKENIZER.encode(F.col("title"))).alias("n_title")
    )


DECODED = f"""WITH vocabulary AS (SELECT id, min(t) AS word FROM (
            SELECT 2 + ('0x' || substr(md5(t), 1, 15))::BIGINT AS id, t
            FROM (SELECT DISTINCT unnest({sql_words('text')}) AS t FROM documents)) GROUP BY id),
        words AS (SELECT doc_id, unnest({sql_words('text')}) AS t, generate_subscripts({sql_words('text')}, 1) AS pos FROM documents),
        named AS (SELECT doc_id, pos, word FROM words JOIN vocabulary ON id = 2 + ('0x' || substr(md5(t), 1, 15))::BIGINT)
    SELECT d.doc_id, coalesce(x.decoded, '') AS decoded FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS decoded FROM named GROUP BY doc_id) x USING (doc_id)"""


def decoded(spark, d, **how):
    documents = spread_small(v.table(spark, d, "documents"))
    encoded = documents.select("doc_id", TOKENIZER.encode(F.col("text")).alias("tokens"))
    vocabulary = cut_lineage(build_vocabulary(documents, "text"))
    return decode(encoded, "doc_id", "tokens", vocabulary, **how)


@query("decode", DECODED)
def decode_query(spark, d):
    return decoded(spark, d)


@query("decode_joined", DECODED)
def decode_joined_query(spark, d):
    """The way of vocabularies too large to send to every task."""
    return decoded(spark, d, small_vocabulary=0)


@query(
    "mask_query_labels",
    with_views(f"{TOKEN_BASE} SELECT id, {sql_joined('list_transform(tokens, lambda x, i: CASE WHEN i <= n_query THEN -100 ELSE x END)')} AS labels FROM b", "v_posts"),
)
def mask_query_labels_query(spark, d):
    return _token_base(spark, d).select("id", joined(seq.mask_query_labels(F.col("tokens"), F.col("n_query"))).alias("labels"))


@query(
    "mask_pad_labels",
    with_views(
        f"{TOKEN_BASE}, p AS (SELECT id, list_concat(tokens, {sql_fill('0', '575 - len(tokens)')}) AS t FROM b) "
        f"SELECT id, {sql_joined('list_transform(t, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM p",
        "v_posts",
    ),
)
def mask_pad_labels_query(spark, d):
    padded = _token_base(spark, d).withColumn("padded", seq.pad(F.col("tokens"), 575, 0))
    return padded.select("id", joined(seq.mask_pad_labels(F.col("padded"), 0)).alias("labels"))


@query(
    "attention_mask",
    with_views(
        f"{TOKEN_BASE}, p AS (SELECT id, list_concat({sql_fill('0', '512 - len(tokens)')}, tokens) AS t FROM b) "
        "SELECT id, len(list_filter(t, lambda x: x <> 0))::INT AS n_true, array_to_string(list_transform(t, lambda x: CASE WHEN x <> 0 THEN '1' ELSE '0' END), '') AS bits FROM p",
        "v_posts",
    ),
)
def attention_mask_query(spark, d):
    padded = _token_base(spark, d).withColumn("padded", seq.pad(F.col("tokens"), 512, 0, "left"))
    masked = padded.withColumn("mask", seq.attention_mask(F.col("padded"), 0))
    bits = F.array_join(F.col("mask").cast("array<int>").cast("array<string>"), "")
    return masked.select("id", F.size(F.array_remove("mask", F.lit(False))).alias("n_true"), bits.alias("bits"))


@query(
    "response_only",
    with_views(f"{TOKEN_BASE} SELECT id, {sql_joined('list_transform(tokens, lambda x, i: CASE WHEN i <= n_query THEN 0 ELSE x END)')} AS tokens FROM b", "v_posts"),
)
def response_only_query(spark, d):
    return _token_base(spark, d).select("id", joined(seq.response_only(F.col("tokens"), F.col("n_query"), 0)).alias("tokens"))


@query(
    "shift_next_token",
    with_views(
        f"{TOKEN_BASE}, l AS (SELECT id, tokens, list_transform(tokens, lambda x, i: CASE WHEN i <= n_query THEN -100 ELSE x END) AS labels FROM b) "
        f"SELECT id, {sql_joined('tokens[1:len(tokens) - 1]')} AS inputs, {sql_joined('labels[2:len(labels)]')} AS labels FROM l",
        "v_posts",
    ),
)
def shift_next_token_query(spark, d):
    labelled = _token_base(spark, d).withColumn("labels", seq.mask_query_labels(F.col("tokens"), F.col("n_query")))
    shifted = labelled.withColumn("pairs", seq.shift_next_token(F.col("tokens"), F.col("labels")))
    return shifted.select("id", joined("pairs.input").alias("inputs"), joined("pairs.label").alias("labels"))


@query(
    "split_context",
    with_views(
        f"{TOKEN_BASE} SELECT id, {sql_joined('tokens[1:n_query]')} AS prompt, {sql_joined('tokens[n_query + 1:len(tokens)]')} AS response, "
        f"{sql_joined('tokens')} AS rejoined FROM b",
        "v_posts",
    ),
)
def split_context_query(spark, d):
    prompt, response = seq.split_context(F.col("tokens"), F.col("n_query"))
    parts = _token_base(spark, d).select("id", prompt.alias("prompt"), response.alias("response"))
    whole = seq.join_context(F.col("prompt"), F.col("response"))
    return parts.select("id", joined("prompt").alias("prompt"), joined("response").alias("response"), joined(whole).alias("rejoined"))


@query(
    "first_true_index",
    with_views(
        " SELECT vec_id, coalesce(list_position(list_transform(scores, lambda x: x > 1.0), true) - 1, 64)::BIGINT AS first_above, "
        "coalesce(list_position(list_transform(scores, lambda x: x > 9.0), true) - 1, 64)::BIGINT AS never FROM v_scores_at",
        "v_scores_at",
    ),
)
def first_true_index_query(spark, d):
    def above(bound):
        return seq.first_true_index(F.transform("scores", lambda x: x > bound))

    return v.scores_at(spark, d).select("vec_id", above(1.0).alias("first_above"), above(9.0).alias("never"))


@query(
    "score_at_eos",
    with_views(
        ", t AS (SELECT vec_id, scores, list_position(list_transform(scores, lambda x: CASE WHEN x > 0.9 THEN 1 ELSE 2 END), 1) AS p FROM v_scores_at) "
        f"SELECT vec_id, {v.sql_round('CASE WHEN p > 0 THEN scores[p] ELSE -1 END')} AS score, "
        f"{v.sql_round('CASE WHEN p > 1 THEN scores[p] ELSE -1 END')} AS strict_score FROM t",
        "v_scores_at",
    ),
)
def score_at_eos_query(spark, d):
    tokens = F.transform("scores", lambda x: F.when(x > 0.9, F.lit(1)).otherwise(F.lit(2)).cast("bigint"))
    rows = v.scores_at(spark, d).withColumn("tokens", tokens)
    score, strict = (seq.score_at_eos(F.col("scores"), F.col("tokens"), 1, compat) for compat in (False, True))
    return rows.select("vec_id", rounded(score).alias("score"), rounded(strict).alias("strict_score"))


@query(
    "terminal_reward",
    with_views(
        f" SELECT event_id, {v.sql_round('reward')} AS total_reward, "
        "CASE WHEN n_tokens = 0 OR reward = 0 THEN -1 ELSE n_tokens - 1 END AS reward_index, 64 AS width FROM v_rollouts",
        "v_rollouts",
    ),
)
def terminal_reward_query(spark, d):
    rewards = seq.terminal_reward(F.col("token_scores"), F.col("response_tokens"), 0, 1)
    rows = v.rollouts(spark, d).select("event_id", rewards.alias("rewards"))
    total = F.aggregate("rewards", F.lit(0.0), lambda s, x: s + x)
    first = seq.first_true_index(F.transform("rewards", lambda x: x != 0.0))
    return rows.select(
        "event_id",
        rounded(total).alias("total_reward"),
        F.when(first == F.size("rewards"), F.lit(-1)).otherwise(first).cast("int").alias("reward_index"),
        F.size("rewards").alias("width"),
    )


@query(
    "fan_out",
    "SELECT doc_id, r::INT AS response_no FROM documents CROSS JOIN range(8) AS x(r)",
)
def fan_out_query(spark, d):
    return fan_out(v.table(spark, d, "documents").select("doc_id"), 8)


@query(
    "zip_records",
    with_views(
        f" SELECT vec_id, unnest(range(64))::INT AS pos, {v.sql_round('unnest(log_probs)')} AS log_prob, unnest(mask) AS kept FROM v_token_log",
        "v_token_log",
    ),
)
def zip_records_query(spark, d):
    zipped = seq.zip_records(log_prob=F.col("log_probs"), kept=F.col("mask"))
    rows = v.token_log(spark, d).select("vec_id", F.posexplode(zipped).alias("pos", "record"))
    return rows.select("vec_id", "pos", rounded("record.log_prob").alias("log_prob"), "record.kept")
