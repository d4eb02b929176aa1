"""Ranked lexical search: interval search over posting lists with range-maximum sparse tables.

1. One pass cuts the documents into shards (some megabytes of text each) and keeps the postings of the
   terms that are asked for, with the document counts of those terms; nothing but these is shuffled.
2. In a shard the documents are numbered by their ids. Over the impacts of each posting list lies a sparse
   table, which answers "the largest impact between two documents" in constant time. The answers of an
   item's terms, summed, bound every score in an interval of documents.
3. Intervals are taken best bound first. The document of the largest impact of any term splits its interval:
   it is scored, the parts on both sides are bounded anew, and parts whose bound is below the k-th best
   score so far are dropped. Parts with few postings are scored at once.
4. The best k of each shard and item meet in a ranked window, which Spark limits to k rows a task and item
   before its shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.text import LOWER, NOT_LETTERS, blocks, words
from prefloom.session import scratch_path

K1_TIMES_B, K1_TIMES_REST, SCALE = 25, 75, 1_000_000_000  # the length norm is 75 + 25 * n / mean length
SHARD_BYTES = 16 << 20
ITEM_BYTES = 4 << 20  # items of so much text are asked at a time
FEW_POSTINGS = 256
AT_ONCE = 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of consecutive texts, and where each text's terms begin."""
    own = words(LOWER[data], offsets, NOT_LETTERS)
    return own.hash, own.first


class Postings:
    """Posting lists of a shard one after the other, with a sparse table of the largest impacts.

    ``level[j][p]`` is the place of the largest impact among the 2**j postings from p on (of equal ones the first).
    """

    def __init__(self, first: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        self.first, self.doc, self.impact, self.documents = first, doc, impact, documents
        self.key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * documents + doc
        level = [np.arange(len(doc), dtype=np.int32)]
        longest = int(np.diff(first).max(initial=0))
        while 2 << (len(level) - 1) <= longest:
            half, below = 1 << (len(level) - 1), level[-1]
            a, b = below[: len(below) - half], below[half:]
            level.append(np.where(impact[a] >= impact[b], a, b).astype(np.int32))
        width = len(doc)
        self.level = np.zeros((len(level), width), dtype=np.int32)
        for j, row in enumerate(level):
            self.level[j, : len(row)] = row

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact in [low, high), which must not be empty."""
        j = np.frexp((high - low).astype(np.float64))[1] - 1
        a, b = self.level[j, low], self.level[j, high - (1 << j)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def search(self, term: np.ndarray, times: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents of the ``k`` best (equal scores: the smaller document) with ``least`` or more."""
        best: list[tuple[int, int]] = []  # heap of (score, -document), the worst first

        def add(score: np.ndarray, doc: np.ndarray) -> None:
            for s, d in zip(score.tolist(), doc.tolist()):
                if s < least:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -d))
                elif (s, -d) > best[0]:
                    heapq.heapreplace(best, (s, -d))

        def hopeless(bound: int, low_doc: int) -> bool:
            return bound < least or len(best) == k and (bound, -low_doc) < best[0]

        def score_all(low: np.ndarray, high: np.ndarray) -> None:
            n = (high - low).ravel()
            place = np.repeat(low.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
            weight = np.repeat(np.broadcast_to(times, low.shape).ravel(), n)
            doc, group = np.unique(self.doc[place], return_inverse=True)
            score = np.zeros(len(doc), dtype=np.int64)
            np.add.at(score, group, weight * self.impact[place])
            add(score, doc)

        waiting: list[tuple[int, int, int, np.ndarray, np.ndarray, int]] = []
        number = 0

        def put(low: np.ndarray, high: np.ndarray, low_doc: np.ndarray) -> None:
            nonlocal number
            size = (high - low).sum(axis=1)
            few = (size > 0) & (size <= FEW_POSTINGS)
            if few.any():
                score_all(low[few], high[few])
            many = size > FEW_POSTINGS
            low, high, low_doc = low[many], high[many], low_doc[many]
            there = high > low
            place = np.zeros(low.shape, dtype=np.int64)
            place[there] = self.largest(low[there], high[there])
            part = np.where(there, times * self.impact[place], 0) if len(self.impact) else np.zeros(low.shape, np.int64)
            bound, peak = part.sum(axis=1), part.argmax(axis=1)
            for i in range(len(low)):
                b, first = int(bound[i]), int(low_doc[i])
                if not hopeless(b, first):
                    number += 1
                    heapq.heappush(waiting, (-b, first, number, low[i], high[i], int(self.doc[place[i, peak[i]]])))

        put(self.first[term][None], self.first[term + 1][None], np.zeros(1, np.int64))
        while waiting:
            taken = []
            while waiting and len(taken) < AT_ONCE:
                if hopeless(-waiting[0][0], waiting[0][1]):
                    waiting.clear()  # the others are bounded lower, or as high and begin later
                else:
                    taken.append(heapq.heappop(waiting))
            if not taken:
                break
            low, high = np.stack([t[3] for t in taken]), np.stack([t[4] for t in taken])
            doc = np.array([t[5] for t in taken])
            place = np.searchsorted(self.key, term * self.documents + doc[:, None])
            inside = np.minimum(place, len(self.doc) - 1)
            there = (place < high) & (self.doc[inside] == doc[:, None])
            add(np.where(there, times * self.impact[inside], 0).sum(axis=1), doc)
            first = np.array([t[1] for t in taken])
            put(np.concatenate([low, place + there]), np.concatenate([place, high]), np.concatenate([first, doc + 1]))
        found = sorted(best, key=lambda x: (-x[0], -x[1]))
        return np.array([s for s, _ in found], np.int64), np.array([-d for _, d in found], np.int64)


def shard_postings(docs: DataFrame, known) -> DataFrame:
    """Rows (id, length, term, doc, tf: arrays of one shard; n, total: its documents with terms and all their terms).

    ``known`` broadcasts the sorted hashes of the terms asked for; documents without any of them only count.
    """
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "length", "term", "doc", "tf", "n", "total"]

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        held: list[tuple] = []
        size = base = n = total = 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            length, term, doc, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, *map(pa.array, (length, term, doc, tf)))]
            return pa.RecordBatch.from_arrays([*one, pa.array([n], pa.int64()), pa.array([total], pa.int64())], names)

        for block in blocks(batches):
            value, first = terms(block.data, block.offsets)
            count = np.diff(first)
            n, total = n + int((count > 0).sum()), total + int(count.sum())
            place = np.minimum(np.searchsorted(wanted, value), max(len(wanted) - 1, 0))
            hit = wanted[place] == value if len(wanted) else np.zeros(len(value), bool)
            text = np.repeat(np.arange(len(count)), count)[hit]
            pair, tf = np.unique(text << 32 | place[hit], return_counts=True)
            text, term = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
            some, doc = np.unique(text, return_inverse=True)
            ids = block.rows.column("id").take(pa.array(some))
            held.append((ids, count[some].astype(np.int64), term, (base + doc).astype(np.int32), tf.astype(np.int64)))
            base, size = base + len(some), size + len(block.data)
            if size >= SHARD_BYTES:
                yield out()
                held, size, base, n, total = [], 0, 0, 0, 0
        if held:
            yield out()

    schema = f"id array<{kind}>, length array<long>, term array<int>, doc array<int>, tf array<long>, n long, total long"
    return docs.mapInArrow(gather, schema)


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """Rows (no, id, score): the ``k`` best of all documents for the ``no``-th of the texts ``items``."""
    spark = docs.sparkSession
    raw = [(t or "").encode() for t in items]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    value, first = terms(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    wanted, place = np.unique(value, return_inverse=True)
    asked = [np.unique(place[first[i] : first[i + 1]], return_counts=True) for i in range(len(items))]
    path = scratch_path(spark, "postings")
    shard_postings(docs, spark.sparkContext.broadcast(wanted)).write.parquet(path)
    shards = spark.read.parquet(path)
    size = shards.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = size["n"] or 0, size["total"] or 0

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(wanted))
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "df"])

    holding = np.zeros(len(wanted), dtype=np.int64)
    for row in shards.select("term").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        holding[row["term"]] = row["df"]
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * holding + 1))).astype(np.int64)
    plan = spark.sparkContext.broadcast((weight, asked))
    kind = docs.schema["id"].dataType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = plan.value
        # The k-th best score of the task's earlier shards: a document below it is no result.
        reached: list[list[int]] = [[] for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("id").slice(row, 1).flatten()
                length, term, doc, tf = (batch.column(c).slice(row, 1).flatten().to_numpy() for c in ("length", "term", "doc", "tf"))
                if not len(term):
                    continue
                by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(len(by_id), dtype=np.int64)
                place[by_id] = np.arange(len(by_id))
                order = np.lexsort((place[doc], term))
                term, tf, doc = term[order], tf[order], place[doc[order]]
                norm = K1_TIMES_REST + (K1_TIMES_B * length[by_id[doc]] * n) // total
                impact = weight[term] * ((SCALE * tf) // (1000 * tf + 12 * norm))
                first = np.searchsorted(term, np.arange(len(weight) + 1))
                lists = Postings(first, doc, impact, len(by_id))
                no, scores, docs = [], [], []
                for i, (own, times) in enumerate(asked):
                    held = first[own + 1] > first[own]
                    if not held.any():
                        continue
                    least = reached[i][0] if len(reached[i]) == k else 1
                    score, found = lists.search(own[held], times[held], k, least)
                    for s in score.tolist():
                        if len(reached[i]) < k:
                            heapq.heappush(reached[i], s)
                        elif s > reached[i][0]:
                            heapq.heapreplace(reached[i], s)
                    no.append(np.full(len(score), i))
                    scores.append(score)
                    docs.append(by_id[found])
                if no:
                    out = ids.take(pa.array(np.concatenate(docs)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(no)), out, pa.array(np.concatenate(scores))], ["no", "id", "score"])

    return shards.select("id", "length", "term", "doc", "tf").mapInArrow(search, f"no long, id {kind}, score long")


def ranked(
    documents: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Columns ``item_column``, rank int (from 1), ``id_column``, score: the ``k`` documents with the highest score for each item.

    A term is a run of letters, digits and characters beyond ASCII, A-Z lower-cased (compared by 64-bit
    hashes). Only scores above 0 count; equal scores rank by ascending id, NULL ids last. NULL and empty
    texts hold no term: such items get no row and such documents are no result. A repeated document is a
    document of its own, a repeated item gets its rows again; other columns are ignored, also those named like
    results. Items are asked ``item_bytes`` of text at a time, so what is broadcast is bounded; each further
    lot reads the documents again.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"))
    bytes_asked = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    lots = -(-bytes_asked // item_bytes)
    kinds = f"no long, item {asked.schema['item'].dataType.simpleString()}"
    found = None
    for lot in range(max(1, lots)):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(max(1, lots))) == lot).where("text is not null").collect()
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], kinds)
        place = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = _search(docs, [r["text"] for r in rows], k).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        own = best.join(F.broadcast(names), "no").select("item", "rank", "id", "score")
        found = own if found is None else found.unionByName(own)
    return found.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
