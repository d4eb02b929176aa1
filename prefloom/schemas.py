"""Declared record schemas and preprocessing parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STRING, _INT = T.StringType(), T.IntegerType()

INFO = _struct(id=_STRING, post=_STRING, title=_STRING, subreddit=_STRING, site=_STRING, article=_STRING)

COMPARISON = _struct(
    info=INFO,
    summaries=T.ArrayType(_struct(text=_STRING, policy=_STRING, note=_STRING)),
    choice=_INT,
    worker=_STRING,
    batch=_STRING,
    split=_STRING,
    extra=_struct(confidence=_INT),
)

AXES = _struct(overall=_INT, accuracy=_INT, coverage=_INT, coherence=_INT, compatible=T.BooleanType())

AXIS_EVAL = _struct(
    info=INFO,
    summary=_struct(text=_STRING, policy=_STRING, note=_STRING, axes=AXES),
    worker=_STRING,
    batch=_STRING,
    split=_STRING,
)

POST = _struct(id=_STRING, subreddit=_STRING, title=_STRING, post=_STRING, summary=_STRING)

METRIC = _struct(run=_STRING, step=T.LongType(), metric=_STRING, value=T.DoubleType())

# The prompt layout, special texts and widths of the published data sets.
PROMPT_TEMPLATE = "SUBREDDIT: r/{subreddit}\n\nTITLE: {title}\n\nPOST: {post}\n\nTL;DR:"
EOS_TEXT = "<|endoftext|>"
PAD_TEXT = "[PAD]"
IGNORED_LABEL = -100
NEWS_BATCHES = ("batch0_cnndm", "cnndm0", "cnndm2")


@dataclass(frozen=True)
class PromptParams:
    """How a prompt is laid out, cut to its token budget and padded."""

    budget: int = 512
    template: str = PROMPT_TEMPLATE
    cut_field: str = "post"
    cut_text: str = "\n"
    pad_side: str = "left"
    null_text: str = "None"


@dataclass(frozen=True)
class SftParams(PromptParams):
    response_width: int = 63
    total_width: int = 575


@dataclass(frozen=True)
class PairParams(PromptParams):
    response_width: int = 133
    total_width: int = 645
