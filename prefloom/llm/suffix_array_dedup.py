"""Repeated byte strings, found by inserting one byte per document each round.

The contexts of an anchor key are documents aligned at their anchor. Each round takes the next column, one
symbol of every document, and updates two things from those of the round before, in one sequential pass:
the order of the documents by what has been read, latest symbol first (the positional Burrows-Wheeler
order), and the common prefix of neighbours in it (how many latest symbols they share). A window is
repeated where a neighbour shares at least its length. Documents that end or have not begun share nothing.

Columns are read in the order in which they were written; a task holds ``ROWS`` documents at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefloom.llm import exchange
from prefloom.llm.repeats import runs
from prefloom.llm.substring_removal import Repeats, removed_symbols
from prefloom.llm.text import _BYTES, blocks

LENGTH = 400
ROWS = 20_000
HOT = 4096  # contexts of a key whose windows are counted one by one
PART_BYTES = 1 << 20


def byte_symbols(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    row = 0
    for block in blocks([batch], "text", PART_BYTES):
        yield _BYTES[block.data], block.data, block.offsets, row
        row += block.rows.num_rows


def insert_columns(columns: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rounds over ``columns`` (one row of symbols to a column, 256 where a document has none): after each,
    its number and the documents whose latest ``length`` symbols another document of the group shares.

    ``group`` is ascending; only documents of a group are compared.
    """
    n = columns.shape[1]
    order, common = np.arange(n), np.zeros(n, dtype=np.int32)
    for number, column in enumerate(columns):
        symbol = column[order].astype(np.int64)
        key = group[order] * 257 + symbol
        insert = np.argsort(key, kind="stable")
        ordered = key[insert]
        # Between two documents that got the same symbol lie those that got others: the least of their
        # common prefixes is what the two had in common.
        if n > 1:
            pairs = np.empty(2 * (n - 1), dtype=np.int64)
            same = (ordered[1:] == ordered[:-1]) & (symbol[insert[1:]] != 256)
            pairs[::2] = np.where(same, insert[:-1] + 1, 0)
            pairs[1::2] = np.where(same, insert[1:] + 1, 1)
            padded = np.append(common, np.int32(0))
            least = np.minimum.reduceat(padded, pairs)[::2]
            common = np.zeros(n, dtype=np.int32)
            common[1:] = np.where(same, least + 1, 0)
        order = order[insert]
        if number + 1 >= length:
            enough = common >= length
            shared = enough.copy()
            shared[:-1] |= enough[1:]
            yield number, order[shared]


def compare_columns(table: pa.Table, length: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each context (sorted by key) with repeated windows: its row, and which of its windows are."""
    key = table.column("key").to_numpy()
    at, lo, hi = (table.column(c).to_numpy() for c in ("at", "lo", "hi"))
    several = table.column("several").to_numpy()
    symbols = table.column("symbols").combine_chunks()
    symbols = symbols.chunk(0) if isinstance(symbols, pa.ChunkedArray) else symbols
    w = length - k + 1
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key
    first = 0
    while first < len(key):
        last = int(np.searchsorted(group, group[min(first + ROWS, len(key)) - 1], side="left" if first + ROWS < len(key) else "right"))
        if last <= first:  # one group of more rows
            last = int(np.searchsorted(group, group[first], side="right"))
        m = last - first
        columns = np.full((m, w - 1 + length), 256, dtype=np.uint16)
        for i in range(m):
            own = np.frombuffer(symbols[first + i].as_buffer(), np.uint8)
            begin = lo[first + i] - at[first + i] + w - 1
            columns[i, begin : begin + len(own)] = own
        flags = np.zeros((m, 2 * w), dtype=bool)
        for number, rows in insert_columns(np.ascontiguousarray(columns.T), group[first:last] - group[first], length):
            flags[rows, number + 1 - length] = True
        for i in np.flatnonzero(flags.any(axis=1)):
            begin = lo[first + i] - at[first + i] + w - 1
            if not several[first + i]:  # else its windows are settled already
                yield first + i, flags[i, begin : begin + hi[first + i] - lo[first + i] + 1]
        first = last


def remove_repeats(
    df: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """Columns ``id_column``, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), and kept (what
    remains, as bytes: a cut may fall inside a character) unless ``keep_text`` is False.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this text or
    another. NULL counts as empty; repeated rows remove each other, whatever their ids; other columns are
    ignored; an empty table gives no rows.
    """
    k = length - length // 2 + 1
    stored = exchange.write_blocks(df, id_column, text_column)
    job = Repeats(
        byte_symbols, lambda t: compare_columns(t, length, k), length, k, "uint8", False, exchange.BLOCK_BYTES * 4 // length, HOT
    )
    found = job.find(stored)
    kind = df.schema[id_column].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, settled, more in zip(batch.column("payload"), batch.column("settled"), batch.column("found")):
                docs = exchange.unpacked(payload.as_py())
                texts = docs.column(1).cast(pa.large_binary()).fill_null(b"")
                sizes = np.array([len(t.as_buffer()) for t in texts], dtype=np.int64)
                ends = np.cumsum(sizes)
                gone = removed_symbols(settled.as_py(), more.values if more.is_valid else None, int(ends[-1]), length)
                rows = []
                for text, a, b in zip(texts, ends - sizes, ends):
                    own = gone[a:b]
                    body = np.frombuffer(text.as_buffer(), np.uint8)[~own].tobytes()
                    s, e = runs(own)
                    rows.append(
                        (
                            int(b - a),
                            int(own.sum()),
                            len(s),
                            hashlib.sha256(body).hexdigest(),
                            [{"start": int(x), "end": int(y)} for x, y in zip(s, e)],
                            body if keep_text else None,
                        )
                    )
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.binary()]
                arrays = [docs.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = (
        f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>, kept binary"
    )
    out = stored.join(found, "block").mapInArrow(cut, schema).withColumnRenamed("id", id_column)
    return out if keep_text else out.drop("kept")
