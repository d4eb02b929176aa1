"""Words and byte blocks of whole texts as numpy arrays, shared by the operators of this subpackage.

Texts arrive as Arrow batches; they are cut into blocks of a few megabytes (a longer text is a block of
its own), so the arrays of one task stay small whatever the batch holds.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

BLOCK_BYTES = 2 << 20

# Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; both are ASCII, so bytes will do.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTERS = np.zeros(256, dtype=bool)
NOT_LETTERS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept for the next block."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64) if have is None else have
        while len(have) < n:
            step = np.uint64(pow(int(base), len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of ranges of a sequence, each in constant time from one running sum."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = _BASE):
        self.inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(base, len(symbols)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Block:
    """Consecutive rows of a batch: their bytes and where each text begins (one more entry at the end)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
            own = offsets[first : last + 1]
            yield Block(batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0])
            first = last


@dataclass
class Words:
    """Words in reading order: byte ranges, 64-bit hashes, and for each text the index of its first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, hashed: bool = True) -> Words:
    """``data`` lower-cased beforehand where the caller wants that; words never cross texts."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separators[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = Spans(_BYTES[data]).of(start, end) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(start, end, value, np.searchsorted(start, offsets))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def extended(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it unlike all ``taken`` ones, whatever their case."""
    known = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn`` over the batches of a task, after which the worker gives back the memory that it no longer needs: it
    stays alive for later tasks, and beside it an executor's other stages run."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it, others need not
            if trim is not None:
                trim(0)

    return run
