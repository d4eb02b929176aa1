"""Windows of L consecutive symbols that occur elsewhere, found by anchors; shared by both substring operators.

Every window is owned by the position whose following k symbols hash least among those that lie wholly
in the window, which depends on the window's symbols alone. So equal windows have equal owners at equal
offsets, and each anchor stands for a run of windows (its context). Blocks ask for all anchors at once:
an anchor whose key is nowhere else is done; where all contexts of a key are equal, one comparison of
hashes settles the whole run; only anchors whose contexts differ somewhere have their symbols compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from prefloom.llm.text import Spans, mixed

NONE, ALL, NOT_FIRST, MIXED = 0, 1, 2, 3


@dataclass
class Anchors:
    """Anchors of a block: position, the run lo..hi of window starts it owns, and the hashes of its next k
    symbols (key) and of all symbols of its windows (context)."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    context: np.ndarray

    @staticmethod
    def joined(parts: list[Anchors]) -> Anchors:
        return Anchors(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("at", "lo", "hi", "key", "context")))


def anchors(symbols: np.ndarray, first: np.ndarray, length: int, k: int, offset: int = 0) -> Anchors:
    """``first``: where each text begins among the symbols, and their number at the end."""
    n, w = len(symbols), length - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    spans = Spans(symbols)
    start = np.arange(n - k + 1)
    grams = spans.of(start, start + k)
    bits = np.uint64(n.bit_length())
    least = (grams >> bits << bits) | start.astype(np.uint64)
    step = 1
    while 2 * step <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if w > step:
        least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
    fits = np.zeros(n + 1, dtype=np.int32)
    ends = np.maximum(first[1:] - length + 1, first[:-1])
    np.add.at(fits, first[:-1], 1)
    np.add.at(fits, ends, -1)
    p = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    if not len(p):
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    own = (least[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)]))
    lo, hi, at = p[new], p[np.concatenate([new[1:], [len(p)]]) - 1], own[new]
    context = mixed(spans.of(lo, hi + length) + (at - lo).astype(np.uint64))
    return Anchors(at + offset, lo + offset, hi + offset, grams[at], context)


def distinct(a: Anchors, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the anchors by key, context and document, and the first of each (key, context) in it."""
    order = np.lexsort((doc, a.context, a.key))
    key, context = a.key[order], a.context[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])]) if len(key) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def merge(requests: list[tuple[np.ndarray, np.ndarray, np.ndarray]], by_document: bool) -> list[np.ndarray]:
    """Answers to (key, context, value) of all blocks. By document the value is the least document of the
    block that has it, and what matters is a smaller one elsewhere; else it is the number of occurrences."""
    sizes = [len(r[0]) for r in requests]
    key, context, value = (np.concatenate([r[i] for r in requests]) for i in range(3))
    order = np.lexsort((context, key))
    key, context, value = key[order], context[order], value[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new_key) - 1
    heads = np.flatnonzero(new_key)
    alike = np.minimum.reduceat(context, heads) == np.maximum.reduceat(context, heads)
    if by_document:
        least = np.minimum.reduceat(value, heads)[group]
        code = np.where(value > least, ALL, NOT_FIRST)
    else:
        code = np.where(np.add.reduceat(value.astype(np.int64), heads)[group] > 1, ALL, NONE)
    code = np.where(alike[group], code, MIXED).astype(np.uint8)
    out = np.empty(len(code), dtype=np.uint8)
    out[order] = code
    return np.split(out, np.cumsum(sizes)[:-1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values: first index and the one after the last."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]
