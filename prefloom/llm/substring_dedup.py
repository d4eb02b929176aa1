"""Repeated word sequences, found by matching statistics over suffix automata of reference shards.

A reference shard holds the contexts that share an anchor key. Its documents come in ascending order:
each streams through the suffix automaton of the smaller ones, which gives the longest match that ends at
every word, and is then added to it unless it was matched whole. The shard of a key travels to one task
and is bounded (see ``substring_removal``); there is no automaton of the whole corpus to broadcast, since
that would grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from prefloom.llm import exchange
from prefloom.llm.substring_removal import Repeats, removed_symbols
from prefloom.llm.text import blocks, words

LENGTH = 13
GRAM = 5  # words of a key
HOT = 512  # contexts of a key whose windows are counted one by one
PART_BYTES = 2 << 20


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added; states are rows of three lists."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # known from an earlier sequence
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, symbol)
                continue
            own = self._state(self.size[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = own
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[own] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, symbol)
            last = own

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest substring that ends there and was added."""
        state, size, out = 0, 0, []
        for symbol in sequence:
            while state > 0 and symbol not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            out.append(size)
        return out


def word_symbols(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    row = 0
    for block in blocks([batch], "text", PART_BYTES):
        own = words(block.data, block.offsets)
        yield own.hash, own.hash, own.first, row
        row += block.rows.num_rows


def compare_shards(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each context (sorted by key) with windows of a smaller document: its row, and which they are."""
    key, doc = table.column("key").to_numpy(), table.column("doc").to_numpy()
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    bodies = table.column("symbols").to_pylist()
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
    for first, last in zip(edges, edges[1:]):
        order = sorted(range(first, last), key=doc.__getitem__)
        automaton = SuffixAutomaton()
        known: dict[bytes, int] = {}  # whole contexts of smaller documents need no second look
        waiting: list[list[int]] = []
        current = None
        for row in order:
            if doc[row] != current:  # a document is not its own reference
                for sequence in waiting:
                    automaton.add(sequence)
                waiting, current = [], doc[row]
            n = hi[row] - lo[row] + 1
            seen = known.setdefault(bodies[row], int(doc[row]))
            if seen < doc[row]:
                yield row, np.ones(n, dtype=bool)
                continue
            sequence = np.frombuffer(bodies[row], np.uint64).tolist()
            longest = automaton.matching_statistics(sequence) if known else []
            flags = np.array(longest[length - 1 :]) >= length
            if flags.any():
                yield row, flags
            if not longest or longest[-1] < len(sequence):
                waiting.append(sequence)


def remove_seen(
    df: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """Columns ``id_column``, n_words, n_removed, kept_sha256, and kept (the words left, joined by one blank) unless
    ``keep_text`` is False.

    A word goes if a window of ``length`` words that covers it also starts in a text with a smaller id.
    A NULL id is smaller than all others; rows with equal ids do not remove each other's words. A NULL text
    has no words; other columns are ignored; an empty table gives no rows. Ids are whole numbers of at most 64
    bits; other types raise TypeError before anything runs (number such rows in the order of their ids first).
    """
    if not isinstance(df.schema[id_column].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_column} is {df.schema[id_column].dataType.simpleString()}; smaller and greater ids need whole numbers")
    gram = min(GRAM, length)
    stored = exchange.write_blocks(df, id_column, text_column)
    job = Repeats(
        word_symbols, lambda t: compare_shards(t, length), length, gram, "uint64", True, exchange.BLOCK_BYTES // 30, HOT
    )
    found = job.find(stored)
    kind = df.schema[id_column].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, settled, more in zip(batch.column("payload"), batch.column("settled"), batch.column("found")):
                docs = exchange.unpacked(payload.as_py())
                texts = [t.as_buffer().to_pybytes().split(None) if t.is_valid else [] for t in docs.column(1).cast(pa.large_binary())]
                ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                gone = removed_symbols(settled.as_py(), more.values if more.is_valid else None, int(ends[-1]), length)
                rows = []
                for text, end in zip(texts, ends):
                    own = gone[end - len(text) : end]
                    body = b" ".join([w for w, g in zip(text, own.tolist()) if not g])
                    kept = body.decode() if keep_text else None
                    rows.append((len(text), int(own.sum()), hashlib.sha256(body).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [docs.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = stored.join(found, "block").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    out = out.withColumnRenamed("id", id_column)
    return out if keep_text else out.drop("kept")
