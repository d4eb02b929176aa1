"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length.

Pieces of equal length are interchangeable, so best fit decreasing over any number of pieces is a walk
over the counts of at most ``max_tokens`` lengths. The driver walks those counts with a segment tree
over remaining capacities, which finds the tightest open bin in logarithmic time, and gets runs "the
a-th to b-th piece of length n go to these bins"; the pieces find their run by their rank among equals.
The size of what passes the driver is bounded by ``max_tokens``, not by the data.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import scratch_path

CACHED_WORDS = 500_000
# Fixed values of word_bpe_49k.json: its word pattern (here for lower-cased texts without UNSAFE characters), and
# the characters that stand for bytes in its vocabulary: printable ones for themselves, the rest from 256 on.
WORD = re.compile(r"[a-z\u00df-\u017e]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
# Texts with other characters than these, or with a special token, go through the tokenizer whole.
UNSAFE = re.compile("[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]|<\\|")
_cache: dict[str, tuple[object, dict[str, bytes]]] = {}


class CapacityTree:
    """Segment tree over the capacities 0..size; a node knows whether an open bin lies below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, capacity: int, present: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = present
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least ``least``."""
        node = self.leaves + least
        while not self.any[node]:
            while node & 1:  # a right child: the next subtree hangs further up
                node //= 2
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first bin, offset in the bin, pieces to a bin), by length and rank.

    A bin of capacity c takes c // length equal pieces in a row: what remains of it after one piece is
    tighter than any other bin that was not tight enough before.
    """
    tree = CapacityTree(size)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: ranges (first bin, number)
    runs, bins = [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if capacity and number:
            open_bins[capacity].append((first, number))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, number = size, bins, -(-left // (size // length))
                bins += number
            else:
                first, number = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            used = min(number, -(-left // each))
            put(capacity, first + used, number - used)
            placed = min(left, used * each)
            runs.append((length, rank, first, size - capacity, each))
            partly = placed - (used - 1) * each  # pieces in the last bin used
            put(capacity - each * length, first, used - 1)
            put(capacity - partly * length, first + used - 1, 1)
            rank, left = rank + placed, left - placed
    return sorted(runs)


def token_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    The tokenizer cuts a text into words and encodes each word by itself; here each word is encoded once
    and looked up afterwards. The cache is emptied when it is full.
    """
    if path not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _cache[path] = (Tokenizer.from_file(path), {})
    tokenizer, known = _cache[path]
    model, out = tokenizer.model, []
    for text in texts:
        if UNSAFE.search(text):
            out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            continue
        split = WORD.findall(text.lower())
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(split).difference(known):
            symbols = word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            known[word] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(symbols)])
        out.append(b"".join([known[word] for word in split]))
    return out


def tokenized_pieces(
    df: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_column: str, text_column: str, keep_ids: bool
) -> DataFrame:
    """One row per piece: its document, place and checksum, and ``nth``, its rank in its task among pieces of its length."""
    ids = ", ids array<int>" if keep_ids else ""
    schema = (
        f"doc {df.schema[id_column].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, "
        f"part int, nth long{ids}"
    )
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc", "piece", "start", "length", "ids_crc32", "part", "nth"] + (["ids"] if keep_ids else [])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for row, own in enumerate(token_bytes(tokenizer, texts)):
                    own += end
                    for piece, start in enumerate(range(0, len(own) // 4, max_tokens)):
                        body = own[4 * start : 4 * (start + max_tokens)]
                        length = len(body) // 4
                        more = [np.frombuffer(body, "<i4")] if keep_ids else []
                        rows.append((row, piece, start, length, zlib.crc32(body), part, seen[length], *more))
                        seen[length] += 1
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                arrays = [batch.column(0).take(pa.array(columns[0], pa.int32()))]
                arrays += [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(cut, schema)


def pack(
    df: DataFrame,
    tokenizer: str,
    max_tokens: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Columns ``id_column``, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Each document is its token ids and ``end_id``; only longer ones than ``max_tokens`` are cut. A NULL
    or empty text is its end id alone; a NULL or repeated id is kept as it is, row by row; other columns
    of ``df`` are not looked at; an empty table gives no rows. Full pieces are sequences of their own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pieces")
    tokenized_pieces(df, tokenizer, max_tokens, end_id, id_column, text_column, keep_ids).write.parquet(path)
    pieces = spark.read.parquet(path)
    # Rank among equals: the pieces of that length in earlier tasks, and those before it in its own.
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(best_fit_runs(counts, max_tokens), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(runs)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            bin_no, slot = np.divmod(rank - own[:, 1], own[:, 4])
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(own[:, 2] + bin_no))
            yield out.append_column("offset", pa.array(own[:, 3] + slot * length))

    kept = ["doc", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    ranked = pieces.join(cells.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*kept).schema)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    return placed.withColumnRenamed("doc", id_column)
