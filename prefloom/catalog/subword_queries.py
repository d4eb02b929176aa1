"""Sub-word tokens, prompts and examples over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.registry import query
from prefloom.catalog.views import NL, joined, sql_fill, sql_fix_width, sql_joined, sql_text, with_views
from prefloom.functions.subwords import SubwordTokenizer
from prefloom.plans.examples import build_sft_examples
from prefloom.schemas import EOS_TEXT, PAD_TEXT, PROMPT_TEMPLATE, SftParams

# A vocabulary for the queries, whose twin must know it too: the single bytes, then these in the order of their ranks.
MERGED = (
    "th", " t", "in", "er", "an", "en", "on", "re", "es", "or", " a", " s", "he", "ou", " o", "de", "ti", "st", "ar", "ch", "the",
    " th", " the", "ing", "and", " an", " and", "ion", "tion", "ent", " de", "ein", "sch", "que", "é", "ü", "..", "--", "  ", "\n\n",
)
LONGEST = max(len(t.encode()) for t in MERGED)
TOKENS = (*(bytes([b]) for b in range(256)), *(t.encode() for t in MERGED))
EOS_ID, PAD_ID = len(TOKENS), len(TOKENS) + 1
TOKENIZER = SubwordTokenizer(TOKENS, PAD_ID, EOS_ID)
BUDGET = 256
EXAMPLES = SftParams(budget=BUDGET, response_width=63, total_width=BUDGET + 63)

_BLANKS = r" \t\n\x0b\x0c\r"
_MAP = "MAP {" + ", ".join(f"'{t.hex().upper()}': {i}" for i, t in enumerate(TOKENS) if i >= 256) + "}"


def sql_sub_words(text: str) -> str:
    """The words of a text; the special texts become one character each before."""
    marked = f"replace(replace({text}, '{EOS_TEXT}', chr(1)), '{PAD_TEXT}', chr(2))"
    return rf"regexp_extract_all({marked}, '\x01|\x02| ?[^{_BLANKS}\x01\x02]+|[{_BLANKS}]+')"


def sql_bpe(words: str) -> str:
    """CTEs that end in ``bpe`` (w, ids): the words of a relation ``words`` (w), merged pair by pair."""
    pairs = "list_transform(range(1, len(s)), lambda i: m[s[i] || s[i + 1]])"
    return rf"""
    bpe0 AS (SELECT w, regexp_extract_all(hex(encode(w)), '..') AS s, {_MAP} AS m, 0 AS step
             FROM (SELECT DISTINCT w FROM {words}) WHERE w NOT IN (chr(1), chr(2))
             UNION ALL
             SELECT w, list_concat(list_concat(s[1:spot - 1], [s[spot] || s[spot + 1]]), s[spot + 2:len(s)]) AS s, m, step + 1 AS step
             FROM (SELECT *, list_position(pairs, list_min(pairs)) AS spot
                   FROM (SELECT *, {pairs} AS pairs FROM bpe0)) WHERE list_min(pairs) IS NOT NULL),
    bpe AS (SELECT w, list_transform(arg_max(s, step), lambda x: coalesce(any_m[x], ('0x' || x)::BIGINT)) AS ids
            FROM (SELECT *, m AS any_m FROM bpe0) GROUP BY w, any_m
            UNION ALL SELECT chr(1), [{EOS_ID}::BIGINT] UNION ALL SELECT chr(2), [{PAD_ID}::BIGINT])"""


def sql_encoded(texts: str, name: str) -> str:
    """CTEs that end in ``name`` (id, which, ids) for a relation ``texts`` (id, which, text)."""
    return rf"""
    {name}_w AS (SELECT id, which, unnest(words) AS w, generate_subscripts(words, 1) AS pos
                 FROM (SELECT id, which, {sql_sub_words('text')} AS words FROM {texts})),
    {sql_bpe(name + '_w').replace('bpe', name + '_bpe')},
    {name} AS (SELECT t.id, t.which, coalesce(x.ids, []) AS ids FROM {texts} t LEFT JOIN (
                 SELECT id, which, flatten(list(ids ORDER BY pos)) AS ids FROM {name}_w JOIN {name}_bpe USING (w) GROUP BY id, which) x USING (id, which))"""


def sql_cut(budget: int) -> str:
    """CTEs that end in ``fitted`` (id, prompt, n_tokens): each candidate in cutting order, and the first within the budget."""
    return rf"""
    c0 AS (SELECT id, {v.sql_prompt("''")} AS empty, coalesce(post, 'None') AS post,
                  string_split(coalesce(post, 'None'), {NL}) AS lines FROM v_posts),
    c1 AS (SELECT id, left(empty, length(empty) - 8) AS head, right(empty, 8) AS tail, post, lines FROM c0),
    c2 AS (SELECT id, head, tail, unnest(list_transform(range(0, len(lines)), lambda i: array_to_string(lines[1:len(lines) - i], {NL}))) AS body,
                  unnest(range(0, len(lines))) AS nth FROM c1
           UNION ALL
           SELECT id, head, tail, left(lines[1], k::INT) AS body, 1000000 + length(lines[1]) - k AS nth
           FROM (SELECT *, unnest(range(0, least(length(lines[1]), {LONGEST * budget}))) AS k FROM c1)),
    c3 AS (SELECT id, nth AS which, head || body || tail AS text FROM c2
           WHERE strlen(head || body || tail) <= {LONGEST * budget} AND (nth < 1000000 OR strlen(head || body || tail) >= {budget - 8} OR body = '')),
    {sql_encoded('c3', 'cand')},
    fitted AS (SELECT v_posts.id, text AS prompt, ids FROM v_posts LEFT JOIN (
                 SELECT id, arg_min(text, which) AS text, arg_min(ids, which) AS ids
                 FROM cand JOIN c3 USING (id, which) WHERE len(ids) <= {budget} GROUP BY id) x USING (id))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _fields():
    return {name: F.col(name) for name in ("subreddit", "title", "post")}


@query(
    "encode_subword",
    recursive(with_views(f", t AS (SELECT id, 0 AS which, coalesce(post, '') AS text FROM v_posts), {sql_encoded('t', 'e')} SELECT id, {sql_joined('ids')} AS tokens FROM e", "v_posts")),
)
def encode_subword(spark, d):
    return v.posts(spark, d).select("id", joined(TOKENIZER.encode(F.col("post"))).alias("tokens"))


@query(
    "truncate_subword",
    recursive(with_views(f", {sql_cut(BUDGET)} SELECT id, prompt, coalesce(len(ids), -1)::INT AS n_tokens, {sql_joined('ids')} AS tokens FROM fitted", "v_posts")),
)
def truncate_subword(spark, d):
    fitted = v.posts(spark, d).select("id", TOKENIZER.fit_prompt_ids(PROMPT_TEMPLATE, _fields(), BUDGET).alias("f"))
    return fitted.select("id", "f.prompt", F.coalesce(F.array_size("f.ids"), F.lit(-1)).alias("n_tokens"), joined("f.ids").alias("tokens"))


@query("decode_subword", "SELECT doc_id, text AS decoded FROM documents")
def decode_subword(spark, d):
    """What was encoded comes back whole."""
    encoded = v.table(spark, d, "documents").select("doc_id", TOKENIZER.encode(F.col("text")).alias("tokens"))
    return encoded.select("doc_id", TOKENIZER.decode(F.col("tokens")).alias("decoded"))


_PAD_LEFT = f"CASE WHEN q IS NOT NULL THEN list_concat({sql_fill(str(PAD_ID), f'{BUDGET} - len(q)')}, q) END"


def _fixed(ids: str, width: int) -> str:
    return f"CASE WHEN {ids} IS NOT NULL THEN list_concat({ids}, {sql_fill(str(PAD_ID), str(width))})[1:{width}] END"


@query(
    "build_sft_examples_subword",
    recursive(
        with_views(
            f", {sql_cut(BUDGET)}, "
            f"q0 AS (SELECT id, prompt, ids AS q, {v.sql_lstrip('prompt')} AS query, ' ' || summary || '{EOS_TEXT}' AS response FROM fitted JOIN v_posts USING (id)), "
            f"q1 AS (SELECT *, {v.sql_strip('query')} || response AS whole FROM q0), "
            "q2 AS (SELECT id, 1 AS which, response AS text FROM q1 UNION ALL SELECT id, 2, whole FROM q1 WHERE whole IS NOT NULL), "
            f"{sql_encoded('q2', 'x')}, "
            "q3 AS (SELECT q1.*, r.ids AS r, w.ids AS b FROM q1 JOIN x r ON r.id = q1.id AND r.which = 1 LEFT JOIN x w ON w.id = q1.id AND w.which = 2), "
            f"q4 AS (SELECT *, {_fixed('b', EXAMPLES.total_width)} AS t FROM q3) "
            "SELECT id, CASE WHEN prompt IS NULL THEN 'over_budget' ELSE 'ok' END AS status, coalesce(query, '') AS query, "
            f"{sql_joined(_PAD_LEFT)} AS query_tokens, {sql_joined(_fixed('r', 63))} AS response_tokens, len(r)::INT AS response_token_length, "
            f"{sql_joined('t')} AS query_and_response_tokens, "
            f"{sql_joined(f'list_transform(t, lambda x, i: CASE WHEN i <= len(q) OR x = {PAD_ID} THEN -100 ELSE x END)')} AS query_and_response_labels, "
            "len(r) <= 63 AS eos_kept FROM q4",
            "v_posts",
        )
    ),
)
def build_sft_examples_subword(spark, d):
    examples = build_sft_examples(v.posts(spark, d), EXAMPLES, TOKENIZER)
    return examples.select(
        "id",
        "status",
        F.coalesce("query", F.lit("")).alias("query"),
        joined("query_tokens").alias("query_tokens"),
        joined("response_tokens").alias("response_tokens"),
        "response_token_length",
        joined("query_and_response_tokens").alias("query_and_response_tokens"),
        joined("query_and_response_labels").alias("query_and_response_labels"),
        "eos_kept",
    )
