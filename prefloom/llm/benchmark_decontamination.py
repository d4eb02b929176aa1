"""Benchmark passages in documents: one Aho-Corasick automaton over all benchmark windows, one scan per text.

Both sides are normalised alike (A-Z lower-cased, words of letters and digits joined by one blank). A
window is ``width`` consecutive words of an item, or the whole of a shorter item. The automaton reads
each text once; the words it hits are mapped back to byte ranges of the original text.

The distinct windows are made and gathered by Spark. Up to about ``WINDOWS`` of them make one automaton, which
travels as a broadcast; a larger benchmark is dealt by hash into as many lots as that takes, and the documents pass
one lot after the other, written in between, so that no task and no driver holds more than one lot. A pass adds
its hits to those of the passes before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.text import LOWER, NOT_LETTERS, blocks, covered, extended, released, words
from prefloom.session import cut_lineage

WIDTH = 13
WINDOWS = 500_000
ADDED = ("n_words", "n_hit", "items", "spans")
RESULTS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_TABLE = bytes(0x20 if NOT_LETTERS[LOWER[b]] else int(LOWER[b]) for b in range(256))


def normalised(text: bytes) -> bytes:
    """Words, lower-cased, each with one blank before and after it."""
    return b" %b " % b" ".join(text.translate(_TABLE).split())


def item_windows(text: str | None, width: int = WIDTH) -> list[bytes]:
    own = (text or "").encode().translate(_TABLE).split()
    if not own:
        return []
    return [b" %b " % b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))]


def benchmark_windows(benchmark: DataFrame, item_column: str, text_column: str, width: int) -> DataFrame:
    """Rows (window, items): each distinct window and the items that have it, sorted as strings; NULL items have no name."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = sorted(set(item_windows(batch.column("text")[row].as_py(), width)))
                item = batch.column("item").slice(row, 1).take(pa.array([0] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), item], ["window", "item"])

    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    rows = items.mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Columns of ``df`` with n_words, n_hit, items (sorted as strings) and spans (byte ranges of the text).

    A word is hit if it lies in any occurrence of a window; overlapping hits count once and make one span.
    NULL and empty texts have no words, NULL or empty items no windows; repeated rows and items are judged
    row by row and item by item; an empty benchmark hits nothing. Columns of ``df`` named like an added one
    are replaced.
    """
    spark = df.sparkSession
    windows = cut_lineage(benchmark_windows(benchmark, item_column, item_text_column, width))
    lots = max(1, -(-windows.count() // WINDOWS))
    rows = df.drop(*[c for c in df.columns if c.lower() in ADDED])
    for lot in range(lots):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(lots)) == lot).toArrow()
        # pyahocorasick reads str: a latin-1 view gives it bytes as they are
        keys = [w.decode("latin-1") for w in own.column("window").to_pylist()]
        values = zip([k.count(" ") - 1 for k in keys], map(tuple, own.column("items").to_pylist()))
        rows = _scanned(rows, spark.sparkContext.broadcast(dict(zip(keys, values))), text_column)
        if lot < lots - 1:
            rows = cut_lineage(rows)
    return rows


def _scanned(df: DataFrame, patterns, text_column: str) -> DataFrame:
    """``df`` with the columns of ADDED, or with the hits of ``patterns`` added to those it has."""
    further = set(ADDED) <= set(df.columns)
    schema = df.schema if further else extended(df.schema, RESULTS)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for window, value in patterns.value.items():
            automaton.add_word(window, value)
        if len(automaton):
            automaton.make_automaton()
        for block in blocks(batches, text_column):
            n_words, n_hit, items, spans = [], [], [], []
            for row in range(block.rows.num_rows):
                raw = block.data[block.offsets[row] : block.offsets[row + 1]].tobytes()
                text = normalised(raw)
                n_words.append(max(text.count(b" ") - 1, 0) if text != b"  " else 0)
                before = block.rows.column("spans")[row].as_py() if further else []
                known = block.rows.column("items")[row].as_py() if further else []
                found = [(end, *value) for end, value in automaton.iter(text.decode("latin-1"))] if len(automaton) else []
                hit = np.zeros(n_words[-1], dtype=bool)
                if found or before:
                    own = words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), NOT_LETTERS, hashed=False)
                    for s in before:
                        hit |= (own.start >= s["start"]) & (own.end <= s["end"])
                if found:
                    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                    for n in {n for _, n, _ in found}:
                        ends = np.array([e for e, m, _ in found if m == n])
                        hit |= covered(np.searchsorted(blanks, ends) - n, n, len(hit))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                n_hit.append(int(hit.sum()))
                items.append(sorted({*known, *(i for _, _, own_items in found for i in own_items)}))
                spans.append([{"start": int(own.start[a]), "end": int(own.end[b - 1])} for a, b in zip(edges[::2], edges[1::2])])
            results = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            others = [c for c in block.rows.schema.names if not further or c not in ADDED]
            arrays = {**{c: block.rows.column(c) for c in others}, **dict(zip(ADDED, results))}
            yield pa.RecordBatch.from_arrays([arrays[c] for c in schema.names], schema.names)

    return df.mapInArrow(released(scan), schema)


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest() -> F.Column:
    return F.sha2(F.array_join("items", ","), 256)


