"""Fixed-width token sequences: padding, labels, masks and per-token rewards.

Where a result is made of runs (pad, kept tokens, pad) it is put together from
``array_repeat``, ``slice`` and ``concat``, which run in generated code; only predicates on
single tokens use a lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.schemas import IGNORED_LABEL

PAD_SIDES = ("left", "right")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def pad(tokens: Column, width: int, pad_id: int, side: str = "right") -> Column:
    """Pad to ``width``; longer sequences stay as they are."""
    if side not in PAD_SIDES:
        raise ValueError(f"Invalid padding side: {side}")
    filler = F.array_repeat(_long(pad_id), F.greatest(F.lit(width) - F.size(tokens), F.lit(0)))
    return F.concat(filler, tokens) if side == "left" else F.concat(tokens, filler)


def fix_width(tokens: Column, width: int, pad_id: int) -> Column:
    """Cut on the right to ``width`` tokens, then pad on the right."""
    return pad(F.slice(tokens, 1, width), width, pad_id)


def token_length(tokens: Column) -> Column:
    return F.size(tokens)


def _blank_prefix(tokens: Column, length: Column, filler: int) -> Column:
    inside = F.least(F.greatest(length, F.lit(0)), F.size(tokens))
    return F.concat(F.array_repeat(_long(filler), inside), F.slice(tokens, inside + 1, F.size(tokens) - inside))


def mask_query_labels(tokens: Column, query_length: Column) -> Column:
    """The first ``query_length`` labels become the ignored label."""
    return _blank_prefix(tokens, query_length, IGNORED_LABEL)


def mask_pad_labels(labels: Column, pad_id: int) -> Column:
    """Pad tokens become the ignored label; the length never changes."""
    return F.transform(labels, lambda x: F.when(x == pad_id, _long(IGNORED_LABEL)).otherwise(x))


def attention_mask(tokens: Column, pad_id: int) -> Column:
    return F.transform(tokens, lambda x: x != pad_id)


def response_only(tokens: Column, query_length: Column, pad_id: int) -> Column:
    """Overwrite the query prefix with pad."""
    return _blank_prefix(tokens, query_length, pad_id)


def next_token_inputs(tokens: Column) -> Column:
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def next_token_labels(labels: Column) -> Column:
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def shift_next_token(tokens: Column, labels: Column) -> Column:
    """Position t of the input beside label t+1, as array<struct<input, label>>."""
    return F.arrays_zip(next_token_inputs(tokens).alias("input"), next_token_labels(labels).alias("label"))


def split_context(tokens: Column, context_length: Column | int) -> tuple[Column, Column]:
    """(prompt part, response part) of a joint sequence."""
    context = F.lit(context_length) if isinstance(context_length, int) else context_length
    return F.slice(tokens, F.lit(1), context), F.slice(tokens, context + 1, F.greatest(F.size(tokens) - context, F.lit(0)))


def join_context(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, response)


def first_true_index(values: Column, wanted: Column | int | bool = True) -> Column:
    """0-based index of the first ``wanted`` element, or the sequence length if there is none."""
    spot = F.array_position(values, wanted)
    return F.when(spot > 0, spot - 1).otherwise(F.size(values).cast("bigint"))


def score_at_eos(scores: Column, tokens: Column, eos_id: int, strict_compat: bool = False) -> Column:
    """The score at the first end token, -1 when there is none. ``strict_compat`` also treats
    an end token at position 0 as absent."""
    spot = F.array_position(tokens, _long(eos_id))
    found = spot > (1 if strict_compat else 0)
    return F.when(found, F.get(scores, (spot - 1).cast("int"))).otherwise(F.lit(-1.0))


def valid_length(tokens: Column, pad_id: int) -> Column:
    """Number of tokens that are not pad."""
    return F.size(F.array_remove(tokens, _long(pad_id)))


def terminal_score(scores: Column, response: Column, pad_id: int, eos_id: int, no_eos_penalty: float = -1.0) -> Column:
    """The one non-zero reward of a response: its score at the last token, or the penalty when
    the response never ends; 0 for an empty response."""
    n = valid_length(response, pad_id)
    ends = F.array_contains(response, _long(eos_id))
    return F.when(n == 0, F.lit(0.0)).when(ends, F.get(scores, n - 1)).otherwise(F.lit(no_eos_penalty))


def terminal_reward(scores: Column, response: Column, pad_id: int, eos_id: int, no_eos_penalty: float = -1.0) -> Column:
    """Per-token rewards: zero but for the last response token."""
    n, zero = valid_length(response, pad_id), F.lit(0.0)
    at_end = F.concat(
        F.array_repeat(zero, n - 1),
        F.array(terminal_score(scores, response, pad_id, eos_id, no_eos_penalty)),
        F.array_repeat(zero, F.size(response) - n),
    )
    return F.when(n == 0, F.array_repeat(zero, F.size(response))).otherwise(at_end)


def spread_advantage(advantage: Column, mask: Column) -> Column:
    """The advantage of a sequence on each of its unmasked tokens."""
    return F.transform(mask, lambda m: advantage * m.cast("double"))


def zip_records(**lists: Column) -> Column:
    """Parallel lists as one list of records; ``inline`` turns it into rows."""
    return F.arrays_zip(*[col.alias(name) for name, col in lists.items()])
