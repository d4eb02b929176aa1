"""The job that both substring operators share: which windows are repeated, and what remains of each text.

1. ``write_blocks`` stores the texts once; each block asks for its anchors (see ``repeats``).
2. With the answers each block notes the runs that are settled, and hands out the symbols of each
   distinct context whose key has other contexts elsewhere.
3. These are compared key by key: ordinary keys by the operator's own method, a bounded number of
   contexts at a time; a key with more than ``hot`` contexts is cut into single windows, which are counted
   by Spark with partial aggregation, so no key needs a task of its own.
4. The runs of both go back to the blocks, which cut them out of their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import exchange
from prefloom.llm.repeats import ALL, MIXED, NOT_FIRST, Anchors, anchors, distinct, merge, runs
from prefloom.llm.text import Spans
from prefloom.session import scratch_path

CONTEXT = "key long, doc long, block long, at long, lo long, hi long, start long, several boolean, symbols binary"
FLAGGED = "block long, lo long, hi long"


class Repeats:
    """``symbols(batch)`` cuts the texts of a block into parts (symbols as numbers, first symbol of each text,
    and for every part the row of its first text); ``length`` and ``k`` as in ``repeats.anchors``; ``stored``
    is the type in which symbols are handed out; ``compare`` is the operator's method."""

    def __init__(
        self,
        symbols: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]],
        compare: Callable[[pa.Table], Iterator[tuple[int, np.ndarray]]],
        length: int,
        k: int,
        stored: str,
        by_document: bool,
        keys_to_a_block: int,
        hot: int,
    ):
        self.symbols, self.compare = symbols, compare
        self.length, self.k, self.stored, self.by_document = length, k, stored, by_document
        self.keys_to_a_block, self.hot = keys_to_a_block, hot

    def anchors(self, batch: pa.RecordBatch) -> tuple[Anchors, np.ndarray]:
        """All anchors of a block, and the number of the document of each: its id, or its row where ids do not matter."""
        ids = batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy() if self.by_document else None
        parts, docs, offset = [], [], 0
        for hashed, _, first, row in self.symbols(batch):
            own = anchors(hashed, first, self.length, self.k, offset)
            parts.append(own)
            doc = np.searchsorted(first, own.lo - offset, side="right") - 1 + row
            docs.append(ids[doc] if self.by_document else doc)
            offset += len(hashed)
        return Anchors.joined(parts), np.concatenate(docs).astype(np.int64)

    def request(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        a, doc = self.anchors(batch)
        order, head = distinct(a, doc)
        one = order[head]
        count = np.diff(np.concatenate([head, [len(order)]]))
        value = doc[one] if self.by_document else np.minimum(count, 255).astype(np.uint8)
        return a.key[one], a.context[one], value

    def settle(self, block: int, batch: pa.RecordBatch, reply: np.ndarray) -> tuple[bytes, list[tuple]]:
        """Runs of window starts that are repeated for certain, and the contexts to be compared."""
        a, doc = self.anchors(batch)
        order, head = distinct(a, doc)
        which = np.cumsum(np.isin(np.arange(len(order)), head)) - 1
        code = reply[which]
        leading = np.zeros(len(order), dtype=bool)
        leading[head] = True
        first_doc = doc[order][head][which] if len(order) else doc
        count = np.diff(np.concatenate([head, [len(order)]]))[which] if len(order) else doc
        if self.by_document:
            sure = (code == ALL) | ((code == NOT_FIRST) | (code == MIXED)) & (doc[order] != first_doc)
            open_ = (code == MIXED) & (doc[order] == first_doc)
        else:
            sure = (code == ALL) | (code == MIXED) & (count > 1)
            open_ = (code == MIXED) & leading
        pick = order[sure]
        body = np.concatenate([a.lo[pick], a.hi[pick]]).astype(np.int64).tobytes()
        open_index = order[open_]
        several = (count > 1)[open_]
        sort = np.argsort(a.at[open_index])
        open_index, several = open_index[sort], several[sort]
        rows, offset, at = [], 0, 0
        for _, raw, first, _ in self.symbols(batch):
            while at < len(open_index) and a.lo[open_index[at]] < offset + len(raw):
                i = open_index[at]
                body_of = raw[a.lo[i] - offset : a.hi[i] + self.length - offset].astype(self.stored).tobytes()
                key = int(a.key[i].astype(np.int64))
                rows.append(
                    (key, int(doc[i]), block, int(a.at[i]), int(a.lo[i]), int(a.hi[i]), int(a.lo[i]), bool(several[at]), body_of)
                )
                at += 1
            offset += len(raw)
        return body, rows

    def windows(self, df: DataFrame) -> DataFrame:
        """Contexts of hot keys as single windows, counted over all documents: the runs that are repeated."""
        length, stored = self.length, self.stored

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    bodies = [x.as_buffer() for x in batch.column("symbols")]
                    own = np.frombuffer(b"".join(bodies), stored).astype(np.uint64) + np.uint64(1)
                    base = np.cumsum([0, *(b.size for b in bodies)])[:-1] // np.dtype(stored).itemsize
                    lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
                    row = np.repeat(np.arange(len(lo)), hi - lo + 1)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    start = base[row] + place
                    one = Spans(own).of(start, start + length)
                    two = Spans(own, np.uint64(0xD6E8FEB86659FD93)).of(start, start + length)
                    take = pa.array(row)
                    n = np.where(batch.column("several").to_numpy(zero_copy_only=False), 2, 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(one.astype(np.int64)),
                            pa.array(two.astype(np.int64)),
                            batch.column("doc").take(take),
                            batch.column("block").take(take),
                            pa.array(lo[row] + place),
                            pa.array(n[row]),
                        ],
                        ["one", "two", "doc", "block", "lo", "n"],
                    )

        each = df.mapInArrow(cut, "one long, two long, doc long, block long, lo long, n int")
        if self.by_document:
            found = each.groupBy("one", "two").agg(F.min("doc").alias("least"))
            again = each.join(found, ["one", "two"]).where("doc > least")
        else:
            found = each.groupBy("one", "two").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
            again = each.join(found, ["one", "two"])
        return again.select("block", "lo", F.col("lo").alias("hi"))

    def find(self, blocks: DataFrame) -> DataFrame:
        """Rows (block, settled, found): runs of window starts in the block that are repeated."""
        spark = blocks.sparkSession
        ranges = exchange.ranges_for(blocks, self.keys_to_a_block)
        by_document = self.by_document
        kinds = ("uint64", "int64" if by_document else "uint8")
        replies = exchange.ask(blocks, self.request, lambda r: merge(r, by_document), kinds, "uint8", ranges)

        def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload, parts in zip(batch.column("block"), batch.column("payload"), batch.column("parts")):
                    reply = exchange.joined(parts or [], "uint8") if parts.is_valid else np.zeros(0, np.uint8)
                    body, rows = self.settle(block.as_py(), exchange.unpacked(payload.as_py()), reply)
                    rows = [(None, None, block.as_py(), None, None, None, None, None, body), *rows]
                    names = [f.split()[0] for f in CONTEXT.split(", ")]
                    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        path = scratch_path(spark, "contexts")
        blocks.join(replies, "block", "left").mapInArrow(settle, CONTEXT).write.parquet(path)
        noted = spark.read.parquet(path)
        settled = noted.where(F.col("key").isNull()).select("block", F.col("symbols").alias("settled"))
        contexts = noted.where(F.col("key").isNotNull())
        sizes = contexts.groupBy("key").agg(F.count("*").alias("n"))
        hot = sizes.where(F.col("n") > self.hot).select("key")
        hot_path = scratch_path(spark, "hot")
        hot.write.parquet(hot_path)
        hot = spark.read.parquet(hot_path)
        tasks = max(LEAST_TASKS, contexts.count() // 50_000)
        compare = self.compare

        def flagged(table: pa.Table) -> pa.Table:
            block, lo, hi = [], [], []
            order = np.argsort(table.column("key").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            base, blk = table.column("lo").to_numpy(), table.column("block").to_numpy()
            for row, starts in compare(table):
                a, b = runs(starts)
                block += [blk[row]] * len(a)
                lo += (a + base[row]).tolist()
                hi += (b - 1 + base[row]).tolist()
            return pa.table([pa.array(x, pa.int64()) for x in (block, lo, hi)], ["block", "lo", "hi"])

        ordinary = contexts
        parts = []
        if not hot.isEmpty():
            ordinary = contexts.join(hot, "key", "left_anti")
            parts.append(self.windows(contexts.join(hot, "key", "left_semi")))
        dealt = ordinary.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(tasks)))
        parts.append(
            dealt.groupBy("share").applyInArrow(lambda t: flagged(t.drop_columns(["share"])), FLAGGED)
        )
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        runs_of = found.groupBy("block").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
        return settled.join(runs_of, "block", "left")


LEAST_TASKS = 64


def removed_symbols(settled: bytes, found: pa.Array | None, n: int, length: int) -> np.ndarray:
    """Which of the n symbols of a block a repeated window covers."""
    both = np.frombuffer(settled, np.int64).reshape(2, -1)
    lo, hi = both[0], both[1]
    if found is not None and len(found):
        lo = np.concatenate([lo, found.field("lo").to_numpy()])
        hi = np.concatenate([hi, found.field("hi").to_numpy()])
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + length, -1)
    return np.cumsum(change[:-1]) > 0
