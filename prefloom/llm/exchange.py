"""Blocks of documents that ask for, and get back, facts about 64-bit keys counted over all blocks.

Documents are written once to the shared folder as blocks: a few megabytes of compressed texts to a row.
Each block sends its distinct sorted keys, cut into ranges of the key space (one row to a block and
range), the task of a range merges them over all blocks and answers each block in its own order. What is
shuffled is 8 bytes to a key and no text; no key is hot, as a block sends it once; a lost executor costs
a block or a range. Blocks and ranges are independent of the number of copies of anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.session import scratch_path

BLOCK_BYTES = 4 << 20
LEAST_RANGES = 256
# A row's number is 63 bits: 23 for its partition, 20 for its block in there and 20 for its place in the block.
BLOCK_BITS = ROW_BITS = 20


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_next_batch()


def by_bytes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones: alike bytes lie together and compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_bytes(body: bytes, kind: str | np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def planes(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte: all first bytes, then all second ones. The high bytes are
    nearly all zero, which the shuffle's compression then takes away."""
    return by_bytes(np.diff(keys, prepend=np.uint64(0)))


def from_planes(body: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(body, np.uint64), dtype=np.uint64)


def zipped(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unzipped(body: bytes) -> bytes:
    return pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)


def row_numbers(block: int, first: int, n: int) -> np.ndarray:
    """Numbers of ``n`` consecutive rows of a block, unlike those of all other rows."""
    return (block << ROW_BITS) + first + np.arange(n)


def write_buckets(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` written once below the shared folder, in buckets of its column block: joins on it move no rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, as their path was given
    return stored


def write_blocks(
    df: DataFrame,
    id_column: str,
    text_column: str,
    block_bytes: int = BLOCK_BYTES,
    block_rows: int = 1 << ROW_BITS,
    buckets: int | None = None,
) -> DataFrame:
    """Rows (block, payload); a payload holds the columns id and text of consecutive rows, ``block_rows`` at most."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << BLOCK_BITS
        beyond = number + (1 << BLOCK_BITS)
        held, size, n = [], 0, 0

        def out() -> pa.RecordBatch:
            if number >= beyond:
                raise ValueError(f"a partition has more than {1 << BLOCK_BITS} blocks; read the table in more partitions")
            table = pa.Table.from_batches(held).combine_chunks()
            body = packed(table.to_batches()[0])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary())], ["block", "payload"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + block_bytes - size, side="right")) - 1)
                last = min(last, first + block_rows - n)
                held.append(batch.slice(first, last - first))
                size, n = size + int(ends[last] - ends[first]), n + last - first
                first = last
                if size >= block_bytes or n >= block_rows or first < batch.num_rows:
                    yield out()
                    held, size, n, number = [], 0, 0, number + 1
        if held:
            yield out()

    read = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = read.mapInArrow(pack, "block long, payload binary")
    if buckets is not None:
        return write_buckets(rows, "blocks", buckets)
    path = scratch_path(df.sparkSession, "blocks")
    rows.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ask(
    blocks: DataFrame,
    request: Callable[..., tuple[np.ndarray, ...]],
    merge: Callable[[list[tuple[np.ndarray, ...]]], list[np.ndarray]],
    kinds: tuple[str, ...],
    reply_kind: str,
    ranges: int,
    dense: bool = False,
) -> DataFrame:
    """Rows (block, parts): what ``merge`` answered to the sorted keys of each block, range by range.

    ``request(documents)`` gives sorted uint64 keys (repeats allowed) and arrays of the further ``kinds``
    beside them; ``merge`` gets these of all blocks for one range and gives an array of ``reply_kind`` to each.
    Further columns of ``blocks`` go to ``request`` as they are. ``dense`` messages are compressed one by one, byte
    plane by byte plane, which takes a third off what is shuffled; ``joined`` reads such replies with ``dense`` too.
    """
    bits = max(1, (max(ranges, LEAST_RANGES) - 1).bit_length())
    flat, close = (by_bytes, zipped) if dense else (np.ndarray.tobytes, bytes)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, *further in zip(*batch.columns):
                keys, *more = request(unpacked(payload.as_py()), *further)
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                part = np.flatnonzero(np.diff(edges))
                bodies = [
                    close(b"".join([planes(keys[edges[i] : edges[i + 1]]), *(flat(a[edges[i] : edges[i + 1]]) for a in more)]))
                    for i in part
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int32()),
                        pa.array([block.as_py()] * len(part), pa.int64()),
                        pa.array(bodies, pa.binary()),
                    ],
                    ["part", "block", "body"],
                )

    types = [np.dtype(k) for k in ("uint64", *kinds)]
    width = sum(t.itemsize for t in types)

    def read(body: bytes) -> tuple[np.ndarray, ...]:
        body = unzipped(body) if dense else body
        n = len(body) // width
        at, out = 8 * n, [from_planes(body[: 8 * n])]
        for t in types[1:]:
            out.append(from_bytes(body[at : at + n * t.itemsize], t) if dense else np.frombuffer(body, t, n, at))
            at += n * t.itemsize
        return tuple(out)

    def answer(table: pa.Table) -> pa.Table:
        replies = merge([read(b.as_py()) for b in table.column("body")])
        bodies = [close(flat(np.asarray(r, dtype=reply_kind))) for r in replies]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "body": pa.array(bodies, pa.binary())})

    asked = blocks.mapInArrow(send, "part int, block long, body binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block long, part int, body binary")
    return answered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("parts"))


def joined(parts: Iterable, kind: str, dense: bool = False) -> np.ndarray:
    """The replies to one block, in the order of its keys."""
    if dense:
        return np.concatenate([np.zeros(0, kind), *(from_bytes(unzipped(p["body"].as_py()), kind) for p in parts)])
    return np.frombuffer(b"".join(p["body"].as_py() for p in parts), dtype=kind)


def ranges_for(blocks: DataFrame, keys_to_a_block: int, keys_to_a_range: int = 1 << 20) -> int:
    return max(1, blocks.count() * keys_to_a_block // keys_to_a_range)
