"""Supervised examples and preference pairs from posts and comparisons.

Both are one narrow projection over the input: no shuffle, one pass over each text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.sequences import fix_width, mask_pad_labels, mask_query_labels, pad
from prefloom.functions.text import format_response, join_query_response, lstrip, strip
from prefloom.functions.subwords import SubwordTokenizer, Tokenizer
from prefloom.functions.tokens import WORD_BLANKS, WordTokenizer
from prefloom.operators.records import exclude_batches, pick_chosen_rejected, route_split
from prefloom.schemas import PairParams, PromptParams, SftParams


def with_query(
    df: DataFrame, fields: Mapping[str, Column], params: PromptParams, tokenizer: Tokenizer
) -> DataFrame:
    """Add the cut prompt, its ids before padding (``_query_ids``) and its decoded text
    (``query``). All three are NULL where even an empty cut field is over the budget."""
    cut = (params.template, fields, params.budget, params.cut_field, params.cut_text, params.null_text)
    if isinstance(tokenizer, SubwordTokenizer):  # cutting a prompt leaves its ids at hand
        fitted = df.withColumn("_fitted", tokenizer.fit_prompt_ids(*cut))
        staged = fitted.withColumns({"_prompt": F.col("_fitted.prompt"), "_query_ids": F.col("_fitted.ids")})
    else:
        staged = df.withColumn("_prompt", tokenizer.fit_prompt(*cut))
        staged = staged.withColumn("_query_ids", tokenizer.encode(F.col("_prompt")))
    return staged.withColumn("query", _query(tokenizer))


def _query(tokenizer: Tokenizer) -> Column:
    return lstrip(tokenizer.drop_specials(F.col("_prompt")))


def with_example_ids(df: DataFrame, fields: Mapping[str, Column], params: SftParams, tokenizer: SubwordTokenizer) -> DataFrame:
    """What ``with_query``, ``with_response_ids`` and ``joint_ids`` add, by one Python worker a task instead of three."""
    cut = (params.cut_field, params.cut_text, params.null_text)
    example = tokenizer.fit_example(params.template, fields, F.col("response"), params.budget, params.total_width, *cut)
    names = {"_prompt": "prompt", "_query_ids": "ids", "_response_ids": "response_ids", "_ids": "joint_ids"}
    staged = df.withColumn("_example", example).withColumns({name: F.col(f"_example.{field}") for name, field in names.items()})
    staged = staged.withColumn("response_token_length", F.col("_example.response_tokens"))
    return staged.withColumn("query", _query(tokenizer))


def with_response_ids(df: DataFrame, width: int, tokenizer: Tokenizer) -> DataFrame:
    """Add the first ids of ``response`` and its token count; a tokenizer that runs in Python sees it once."""
    response = F.col("response")
    if isinstance(tokenizer, WordTokenizer):
        return df.withColumns({"_response_ids": tokenizer.encode(response, width), "response_token_length": tokenizer.count(response)})
    staged = df.withColumn("_all_ids", tokenizer.encode(response))
    return staged.withColumns({"_response_ids": F.slice("_all_ids", 1, width), "response_token_length": F.array_size("_all_ids")})


def query_columns(params: PromptParams, tokenizer: Tokenizer) -> dict[str, Column]:
    return {
        "query": F.col("query"),
        "query_tokens": pad(F.col("_query_ids"), params.budget, tokenizer.pad_id, params.pad_side),
        "query_token_length_without_padding": F.size("_query_ids"),
        "status": F.when(F.col("_prompt").isNull(), F.lit("over_budget")).otherwise(F.lit("ok")),
    }


def joint_ids(response: str, response_ids: str, params: SftParams | PairParams, tokenizer: Tokenizer) -> Column:
    """Ids of ``query.strip() + response``, up to the total width.

    Word tokens of the two parts just follow each other where a blank parts them, and where
    stripping the prompt took nothing but blanks between words (no special text either). The
    ids at hand are then enough. Otherwise the joined text is encoded.
    """
    joined = tokenizer.encode(join_query_response(F.col("query"), F.col(response)), params.total_width)
    if not isinstance(tokenizer, WordTokenizer):
        return joined
    same_words = F.btrim(F.col("_prompt"), F.lit(WORD_BLANKS)) == strip(F.col("query"))
    separate = F.col(response).rlike(r"^\s") & same_words
    return F.when(separate, F.slice(F.concat("_query_ids", response_ids), 1, params.total_width)).otherwise(joined)


def _check_widths(params: SftParams | PairParams) -> None:
    if params.pad_side not in ("left", "right"):
        raise ValueError(f"Invalid padding side: {params.pad_side}")


def build_sft_examples(
    posts: DataFrame,
    params: SftParams = SftParams(),
    tokenizer: Tokenizer = WordTokenizer(),
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Padded, label-masked supervised examples from (id, subreddit, title, post, summary).

    Nine columns per example, plus ``keys``, ``status`` (``over_budget`` where no prompt fits;
    the other columns are then NULL) and ``eos_kept`` (false where the response was cut).
    """
    _check_widths(params)
    fields = {name: F.col(name) for name in ("subreddit", "title", "post")}
    response = format_response(F.col("summary"), leading_blank=True, eos_text=tokenizer.eos_text, null_text=params.null_text)
    if isinstance(tokenizer, SubwordTokenizer):
        staged = with_example_ids(posts.withColumn("response", response), fields, params, tokenizer)
    else:
        staged = with_query(posts, fields, params, tokenizer).withColumn("response", response)
        staged = with_response_ids(staged, params.total_width, tokenizer)
        staged = staged.withColumn("_ids", joint_ids("response", "_response_ids", params, tokenizer))
    staged = staged.withColumn("query_and_response_tokens", fix_width(F.col("_ids"), params.total_width, tokenizer.pad_id))
    labels = mask_query_labels(F.col("query_and_response_tokens"), F.size("_query_ids"))
    query = query_columns(params, tokenizer)
    return staged.select(
        *keys,
        *[column.alias(name) for name, column in query.items() if name != "status"],
        "response",
        fix_width(F.col("_response_ids"), params.response_width, tokenizer.pad_id).alias("response_tokens"),
        "response_token_length",
        join_query_response(F.col("query"), F.col("response")).alias("query_and_response"),
        "query_and_response_tokens",
        mask_pad_labels(labels, tokenizer.pad_id).alias("query_and_response_labels"),
        query["status"].alias("status"),
        (F.col("response_token_length") <= params.response_width).alias("eos_kept"),
    )


def build_preference_pairs(
    comparisons: DataFrame,
    params: PairParams = PairParams(),
    tokenizer: Tokenizer = WordTokenizer(),
    keys: Sequence[str] = ("split",),
) -> DataFrame:
    """Chosen/rejected pairs from comparison records: eleven columns per pair, plus ``keys``
    and ``status``."""
    _check_widths(params)
    fields = {name: F.col(f"info.{name}") for name in ("subreddit", "title", "post")}
    staged = with_query(pick_chosen_rejected(comparisons), fields, params, tokenizer)
    for side in ("chosen", "rejected"):
        response = f"{side}_response"
        staged = staged.withColumn(
            response, format_response(F.col(side), eos_text=tokenizer.eos_text, null_text=params.null_text)
        )
        staged = staged.withColumn(f"_{side}_ids", tokenizer.encode(F.col(response), params.total_width))
    query = query_columns(params, tokenizer)
    out = [*keys, *[column.alias(name) for name, column in query.items() if name != "status"]]
    for side in ("chosen", "rejected"):
        response, ids = f"{side}_response", f"_{side}_ids"
        out += [response, fix_width(F.col(ids), params.response_width, tokenizer.pad_id).alias(f"{response}_tokens")]
    for side in ("chosen", "rejected"):
        response, ids = f"{side}_response", f"_{side}_ids"
        joint = joint_ids(response, ids, params, tokenizer)
        out += [
            join_query_response(F.col("query"), F.col(response)).alias(f"query_and_{response}"),
            fix_width(joint, params.total_width, tokenizer.pad_id).alias(f"query_and_{response}_tokens"),
        ]
    return staged.select(*out, query["status"].alias("status"))


def prepare_comparisons(raw: DataFrame) -> DataFrame:
    """Comparison records with data set splits, without the news batches in validation."""
    return exclude_batches(route_split(raw))
