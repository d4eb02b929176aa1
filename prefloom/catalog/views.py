"""The inputs of the registered queries, derived from the given tables.

Each view has a Spark form (a function) and a DuckDB form (an entry of ``SQL_VIEWS``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions.losses import sequence_logp
from prefloom.functions.text import BLANKS
from prefloom.functions.tokens import WordTokenizer
from prefloom.operators.skew import hot_keys, join_unique
from prefloom.sources.tables import spread_small
from prefloom.schemas import AXIS_EVAL, COMPARISON, EOS_TEXT, PAD_TEXT

TOKENIZER = WordTokenizer()
LOG_PROB_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str) -> Column:
    """Doubles as both engines are compared on: six places, no negative zero. The nudge keeps
    exact halves from rounding apart when sums differ in their last bit."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(1e-9), 6) + F.lit(0.0)


def joined(values: Column | str) -> Column:
    """An array as text, '' for NULL."""
    values = F.col(values) if isinstance(values, str) else values
    return F.coalesce(F.array_join(values.cast("array<string>"), ","), F.lit(""))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; the summary is a text's last line, so short and over-long responses both occur."""
    return spread_small(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("subreddit"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("post"),
        F.substring_index("text", "\n", -1).alias("summary"),
    )


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two successive assistant turns of a conversation as the two summaries of its first user
    turn. The turns are found by an equi-join on (conversation, turn), so a long conversation
    is spread over the cluster like any other rows."""
    turns = table(spark, sf_dir, "conversations")
    replies = turns.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    later = replies.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("next_text"))
    pairs = replies.join(later, ["conv_id", "turn"])
    opening = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("post"))
    rows = join_unique(pairs, opening, "conv_id", hot_keys(turns, "conv_id"), spread_by=["turn"], how="left")
    conv, null_text = F.col("conv_id"), F.lit(None).cast("string")
    part = F.when(conv % 4 == 0, "valid1").when(conv % 4 == 1, "valid2").otherwise("train")
    return rows.select(
        F.struct(
            conv.cast("string").alias("id"),
            F.col("post"),
            null_text.alias("title"),
            F.lit("conv").alias("subreddit"),
            null_text.alias("site"),
            null_text.alias("article"),
        ).alias("info"),
        F.array(
            *[
                F.struct(F.col(c).alias("text"), F.lit(p).alias("policy"), null_text.alias("note"))
                for c, p in (("text", "first"), ("next_text", "second"))
            ]
        ).alias("summaries"),
        ((conv + F.col("turn")) % 2).cast("int").alias("choice"),
        F.concat(F.lit("w"), F.col("turn").cast("string")).alias("worker"),
        F.when(conv % 5 == 0, "cnndm0").otherwise(F.concat(F.lit("batch"), (conv % 5).cast("string"))).alias("batch"),
        part.alias("split"),
        F.struct(F.when(conv % 3 != 0, (conv % 9).cast("int")).alias("confidence")).alias("extra"),
    ).to(COMPARISON)


def axis_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated summaries: documents with their labels as axes; most axes are absent somewhere."""
    labels = table(spark, sf_dir, "labels")
    rows = posts(spark, sf_dir).withColumnRenamed("id", "doc_id").join(labels, "doc_id", "left")
    doc, null_text = F.col("doc_id"), F.lit(None).cast("string")
    axes = F.struct(
        F.col("quality").alias("overall"),
        (1 + doc % 7).cast("int").alias("accuracy"),
        F.when(doc % 5 != 0, (1 + doc % 6).cast("int")).alias("coverage"),
        F.when(doc % 3 != 0, (1 + doc % 4).cast("int")).alias("coherence"),
        (F.col("toxic") == 0).alias("compatible"),
    )
    return rows.select(
        F.struct(
            doc.cast("string").alias("id"),
            "post",
            "title",
            F.when(doc % 4 != 0, F.col("subreddit")).alias("subreddit"),
            null_text.alias("site"),
            null_text.alias("article"),
        ).alias("info"),
        F.struct(F.col("summary").alias("text"), F.lit("human").alias("policy"), null_text.alias("note"), axes.alias("axes")).alias("summary"),
        F.lit("w0").alias("worker"),
        F.concat(F.lit("axis"), (doc % 2).cast("string")).alias("batch"),
        F.when(doc % 3 == 0, "test").when(doc % 3 == 1, "valid1").otherwise("valid2").alias("split"),
    ).to(AXIS_EVAL)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive events are the responses to one prompt. A response has 0 to 63 tokens
    in a width of 64, ends with the end token unless the event is an error, and carries its
    value as score at every token."""
    event, n = F.col("event_id"), F.col("n_tokens")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("event_id div 8").alias("prompt_id"),
        (event % 8).cast("int").alias("response_no"),
        F.col("value").alias("score"),
        (F.col("event_type") != "error").alias("has_eos"),
        "event_type",
        (event % 64).cast("int").alias("n_tokens"),
    )
    last = F.when(F.col("has_eos"), F.lit(1)).otherwise(F.lit(7)).cast("bigint")
    word, pad = F.lit(7).cast("bigint"), F.lit(0).cast("bigint")
    tokens = F.when(n == 0, F.array_repeat(pad, 64)).otherwise(
        F.concat(F.array_repeat(word, n - 1), F.array(last), F.array_repeat(pad, 64 - n))
    )
    return rows.withColumn("response_tokens", tokens).withColumn("token_scores", F.array_repeat(F.col("score"), 64))


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged token log-probabilities of one sequence per embedding."""
    n = F.lit(8) + F.col("vec_id") % 57
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("log_probs"),
        F.transform(F.sequence(F.lit(0), F.lit(LOG_PROB_WIDTH - 1)), lambda i: i < n).alias("mask"),
        (F.col("label") - F.lit(4.5)).alias("advantage"),
        "label",
    )


def reference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_log(spark, sf_dir).select("vec_id", F.reverse("log_probs").alias("log_probs"))


def old_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers one place later; every third sequence moved far enough to reach the clamps."""
    moved = F.when(F.col("vec_id") % 3 == 0, F.lit(60.0)).otherwise(F.lit(1.0))
    turned = F.concat(F.slice("log_probs", LOG_PROB_WIDTH, 1), F.slice("log_probs", 1, LOG_PROB_WIDTH - 1))
    return token_log(spark, sf_dir).select("vec_id", F.transform(turned, lambda x: x * moved).alias("log_probs"))


def scores_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("scores")
    )


def pair_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd embeddings as the sides of a pair: score, policy and reference log-prob."""
    log = token_log(spark, sf_dir)
    raw = scores_at(spark, sf_dir).select("vec_id", F.aggregate("scores", F.lit(0.0), lambda s, x: s + x).alias("score"))
    reference = reference_log(spark, sf_dir).select("vec_id", F.col("log_probs").alias("ref_log_probs"))
    return (
        log.join(reference, "vec_id")
        .join(raw, "vec_id")
        .select(
            F.expr("vec_id div 2").alias("pair_id"),
            F.when(F.col("vec_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"),
            "score",
            sequence_logp(F.col("log_probs"), F.col("mask")).alias("policy_logp"),
            sequence_logp(F.col("ref_log_probs"), F.col("mask")).alias("ref_logp"),
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair: chosen and rejected score."""
    raw = scores_at(spark, sf_dir).select("vec_id", F.aggregate("scores", F.lit(0.0), lambda s, x: s + x).alias("score"))
    even = raw.where(F.col("vec_id") % 2 == 0).select(F.expr("vec_id div 2").alias("pair_id"), F.col("score").alias("chosen"))
    odd = raw.where(F.col("vec_id") % 2 == 1).select(F.expr("vec_id div 2").alias("pair_id"), F.col("score").alias("rejected"))
    return even.join(odd, "pair_id")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long run: an evaluation loss per step."""
    return table(spark, sf_dir, "events").select(
        F.lit("r").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("eval_loss")
    )


# --- DuckDB forms ---------------------------------------------------------------------------

NL = "chr(10)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_words(text: str) -> str:
    spaced = text
    for special in (EOS_TEXT, PAD_TEXT):
        spaced = f"replace({spaced}, '{special}', ' {special} ')"
    return rf"regexp_extract_all({spaced}, '\S+')"


def sql_ids(text: str) -> str:
    return (
        f"list_transform({sql_words(text)}, lambda t: CASE WHEN t = '{EOS_TEXT}' THEN 1::BIGINT "
        f"WHEN t = '{PAD_TEXT}' THEN 0::BIGINT ELSE 2 + ('0x' || substr(md5(t), 1, 15))::BIGINT END)"
    )


def sql_strip(text: str) -> str:
    return f"trim({text}, {sql_text(BLANKS)})"


def sql_lstrip(text: str) -> str:
    return f"ltrim({text}, {sql_text(BLANKS)})"


def sql_joined(values: str) -> str:
    return f"coalesce(array_to_string({values}, ','), '')"


def sql_round(value: str) -> str:
    return f"round({value} + 1e-9, 6) + 0.0"


def sql_fill(value: str, n: str) -> str:
    return f"list_resize([]::BIGINT[], greatest({n}, 0), {value}::BIGINT)"


def sql_fix_width(ids: str, width: int) -> str:
    # DuckDB's list_concat reads a NULL list as an empty one.
    return f"CASE WHEN {ids} IS NOT NULL THEN list_concat({ids}, {sql_fill('0', str(width))})[1:{width}] END"


def sql_prompt(post: str) -> str:
    return (
        f"'SUBREDDIT: r/' || coalesce(subreddit, 'None') || {NL} || {NL} || 'TITLE: ' || coalesce(title, 'None') "
        f"|| {NL} || {NL} || 'POST: ' || {post} || {NL} || {NL} || 'TL;DR:'"
    )


def sql_fitted(source: str, keep: str, budget: int = 512) -> str:
    """CTEs that end in ``fitted``: ``keep`` plus the prompt cut to its budget, line by line."""
    empty = sql_prompt("''")
    first_line = (
        r"regexp_extract(lines[1], '^\s*') || array_to_string(regexp_extract_all(lines[1], '\S+\s*')[1:room], '')"
    )
    return rf"""
    f0 AS (SELECT {keep}, subreddit, title, coalesce(post, 'None') AS post FROM {source}),
    f1 AS (SELECT *, string_split(post, {NL}) AS lines, {budget} - len({sql_words(empty)}) AS room FROM f0),
    f2 AS (SELECT *, list_transform(lines, lambda l: len({sql_words('l')})) AS counts FROM f1),
    f3 AS (SELECT *, list_sum(counts) AS total,
                  len(list_filter(list_transform(range(1, len(counts) + 1), lambda i: list_sum(counts[1:i])), lambda s: s <= room)) AS k FROM f2),
    f4 AS (SELECT *, CASE WHEN room < 0 THEN NULL WHEN total <= room THEN post
                  WHEN k > 0 THEN array_to_string(lines[1:k], {NL}) ELSE {first_line} END AS cut FROM f3),
    fitted AS (SELECT {keep}, {sql_prompt('cut')} AS prompt FROM f4)"""


SQL_VIEWS = {
    "v_posts": rf"""v_posts AS (
        SELECT doc_id AS id, source AS subreddit, string_split(text, {NL})[1] AS title, text AS post,
               string_split(text, {NL})[-1] AS summary
        FROM documents)""",
    "v_comparisons": """v_comparisons AS (
        SELECT r.conv_id, r.turn, r.conv_id::VARCHAR AS id, o.post, NULL::VARCHAR AS title, 'conv' AS subreddit,
               r.text AS text0, r.next_text AS text1, ((r.conv_id + r.turn) % 2)::INT AS choice,
               'w' || r.turn AS worker,
               CASE WHEN r.conv_id % 5 = 0 THEN 'cnndm0' ELSE 'batch' || (r.conv_id % 5) END AS batch,
               CASE r.conv_id % 4 WHEN 0 THEN 'valid1' WHEN 1 THEN 'valid2' ELSE 'train' END AS split,
               CASE WHEN r.conv_id % 3 <> 0 THEN (r.conv_id % 9)::INT END AS confidence
        FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
              FROM conversations WHERE role = 'assistant') r
        LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS post FROM conversations WHERE role = 'user' GROUP BY conv_id) o
          ON o.conv_id = r.conv_id
        WHERE r.next_text IS NOT NULL)""",
    "v_axis": """v_axis AS (
        SELECT p.id::VARCHAR AS id, post, title, CASE WHEN p.id % 4 <> 0 THEN subreddit END AS subreddit, summary,
               quality AS overall, (1 + p.id % 7)::INT AS accuracy,
               CASE WHEN p.id % 5 <> 0 THEN (1 + p.id % 6)::INT END AS coverage,
               CASE WHEN p.id % 3 <> 0 THEN (1 + p.id % 4)::INT END AS coherence,
               toxic = 0 AS compatible, 'axis' || (p.id % 2) AS batch,
               CASE p.id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'valid1' ELSE 'valid2' END AS split
        FROM v_posts p LEFT JOIN labels l ON l.doc_id = p.id)""",
    "v_rollouts": """v_rollouts AS (
        SELECT event_id, event_id // 8 AS prompt_id, (event_id % 8)::INT AS response_no, value AS score,
               event_type <> 'error' AS has_eos, event_type, (event_id % 64)::INT AS n_tokens,
               CASE WHEN event_id % 64 = 0 THEN 0.0 WHEN event_type <> 'error' THEN value ELSE -1.0 END AS reward
        FROM events)""",
    "v_token_log": f"""v_token_log AS (
        SELECT vec_id, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS log_probs,
               list_transform(range({LOG_PROB_WIDTH}), lambda i: i < 8 + vec_id % 57) AS mask,
               label - 4.5::DOUBLE AS advantage, label
        FROM embeddings)""",
    "v_aligned": f"""v_aligned AS (
        SELECT vec_id, log_probs AS policy_log_probs,
               list_transform(list_concat(log_probs[{LOG_PROB_WIDTH}:{LOG_PROB_WIDTH}], log_probs[1:{LOG_PROB_WIDTH - 1}]), lambda x: x * CASE WHEN vec_id % 3 = 0 THEN 60.0::DOUBLE ELSE 1.0::DOUBLE END) AS old_log_probs,
               list_reverse(log_probs) AS ref_log_probs, mask, advantage, label
        FROM v_token_log)""",
    "v_tokens": """v_tokens AS (
        SELECT vec_id, label, advantage, unnest(policy_log_probs) AS lp, unnest(old_log_probs) AS old,
               unnest(ref_log_probs) AS ref, unnest(mask) AS m, unnest(range(64)) AS pos FROM v_aligned)""",
    "v_scores_at": """v_scores_at AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS scores FROM embeddings)""",
    "v_sides": """v_sides AS (
        SELECT vec_id // 2 AS pair_id, vec_id % 2 AS odd,
               (SELECT sum(e::DOUBLE) FROM (SELECT unnest(s.scores) AS e)) AS score,
               (SELECT sum(CASE WHEN m THEN v ELSE 0 END) FROM (SELECT unnest(t.log_probs) AS v, unnest(t.mask) AS m)) AS policy_logp,
               (SELECT sum(CASE WHEN m THEN v ELSE 0 END) FROM (SELECT unnest(list_reverse(t.log_probs)) AS v, unnest(t.mask) AS m)) AS ref_logp
        FROM v_token_log t JOIN v_scores_at s USING (vec_id))""",
    "v_pairs": """v_pairs AS (
        SELECT c.pair_id, c.score AS chosen, r.score AS rejected, c.policy_logp AS policy_chosen, c.ref_logp AS ref_chosen,
               r.policy_logp AS policy_rejected, r.ref_logp AS ref_rejected
        FROM v_sides c JOIN v_sides r ON r.pair_id = c.pair_id AND c.odd = 0 AND r.odd = 1)""",
    "v_metrics": "v_metrics AS (SELECT 'r' AS run, event_id AS step, value AS eval_loss FROM events)",
}

_NEEDS = {
    "v_axis": ["v_posts"],
    "v_aligned": ["v_token_log"],
    "v_tokens": ["v_token_log", "v_aligned"],
    "v_sides": ["v_token_log", "v_scores_at"],
    "v_pairs": ["v_token_log", "v_scores_at", "v_sides"],
}


def with_views(body: str, *names: str) -> str:
    """``body`` after a WITH of the named views. A body that starts with its own CTEs begins
    with a comma."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*_NEEDS.get(name, []), name) if n not in wanted]
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in wanted) + body
