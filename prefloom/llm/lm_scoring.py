"""Stupid-backoff scores of every text under the counts of all other texts.

The n-gram count tables lie in ranges of a 64-bit hash. Every block of texts sends its n-grams, exploded and
counted once per block, to their ranges, is joined there to the counts over all blocks (see ``exchange``), and
sums the scores of each text's words. Words and pairs are asked for first; of the longer n-grams only those follow
whose two shorter parts occur in other texts, since no other text can hold the rest. A text does not count for itself: its own n-grams are taken off, so
copies and near copies score high and a text does not vouch for its own words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefloom.llm import exchange
from prefloom.llm.text import LOWER, Spans, Words, blocks, mixed, words

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
PART_BYTES = 2 << 20
MICRO = 1_000_000
RANGE_KEYS = 1 << 22


def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """First row, number of rows and words of a block's texts, some megabytes at a time."""
    row = 0
    for block in blocks([batch], "text", PART_BYTES):
        yield row, block.rows.num_rows, words(LOWER[block.data], block.offsets)
        row += block.rows.num_rows


def grams(own: Words, order: int) -> list[np.ndarray]:
    """Hashes of the 1..order-grams that end at each word, 0 where the text is too short."""
    n = len(own.hash)
    place = np.arange(n) - own.first[:-1][own.text]
    spans = Spans(own.hash)
    out = []
    for o in range(1, order + 1):
        fits = place >= o - 1
        end = np.flatnonzero(fits) + 1
        key = np.zeros(n, dtype=np.uint64)
        key[fits] = mixed(spans.of(end - o, end) + np.uint64(o)) | np.uint64(1)
        out.append(key)
    return out


def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams, without 0, and their counts."""
    key = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    key = key[np.searchsorted(key, 1) :]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(first, append=len(key))


class Texts:
    """The texts of a block, some megabytes a part: n-grams by order, and how often other texts have them."""

    def __init__(self, batch: pa.RecordBatch, order: int):
        self.parts = list(parts(batch))
        self.keys = [grams(own, order) for _, _, own in self.parts]
        self.doc = [own.text for _, _, own in self.parts]
        self.counts: list[list[np.ndarray]] = [[] for _ in self.parts]
        self.total = 0  # words of all blocks

    def asked(self, orders: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of these orders that other texts may have, and their counts; key 0, before those of
        order 1, counts the words. From order 3 on other texts can only have an n-gram whose two parts of one
        word less they have: the others are left out here, in every text that holds them."""
        for keys, counts in zip(self.keys, self.counts):
            for o in orders:
                if o > 2:
                    known = counts[o - 2] > 0
                    keys[o - 1][~(known & np.concatenate([[False], known[:-1]]))] = 0
        key, count = distinct([keys[o - 1] for keys in self.keys for o in orders])
        if 1 in orders:
            n = sum(len(d) for d in self.doc)
            key, count = np.concatenate([np.zeros(1, np.uint64), key]), np.concatenate([[n], count])
        return key, count

    def answered(self, orders: list[int], key: np.ndarray, total: np.ndarray) -> None:
        if 1 in orders:
            self.total = int(total[0])
        for keys, doc, counts in zip(self.keys, self.doc, self.counts):
            counts.extend(others(keys[o - 1], doc, key, total) for o in orders)


def steps(order: int) -> list[list[int]]:
    """Which orders are asked for together; each later step needs the replies to the one before."""
    return [list(range(1, min(order, 2) + 1)), *([o] for o in range(3, order + 1))]


def told(batch: pa.RecordBatch, order: int, replies: list) -> Texts:
    """The texts of a block with the counts that the replies to its first steps give."""
    texts = Texts(batch, order)
    for orders, reply in zip(steps(order), replies):
        key, count = texts.asked(orders)
        texts.answered(orders, key, count + exchange.joined(reply if reply.is_valid else [], "int64", dense=True))
    return texts


def merge(requests: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """How often the other blocks have each n-gram of a block."""
    key, inverse = np.unique(np.concatenate([r[0] for r in requests]), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, inverse, np.concatenate([r[1] for r in requests]))
    replies = np.split(total[inverse], np.cumsum([len(r[0]) for r in requests])[:-1])
    return [reply - r[1] for reply, r in zip(replies, requests)]


def others(key: np.ndarray, doc: np.ndarray, known: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs outside its own text; 0 for key 0."""
    out = np.zeros(len(key), dtype=np.int64)
    place = np.flatnonzero(key)
    order = np.argsort(key[place])
    at = np.empty(len(place), dtype=np.int64)
    at[order] = np.searchsorted(known, key[place[order]])  # several times faster in ascending order
    pair = at * (int(doc[-1]) + 1 if len(doc) else 1) + doc[place]
    order = np.argsort(pair)
    new = np.flatnonzero(np.diff(pair[order], prepend=-1))
    own = np.diff(new, append=len(pair))
    out[place[order]] = total[at[order]] - np.repeat(own, own)
    return out


def scored(own: Words, n: int, counts: list[np.ndarray], total: int, backoff: float) -> tuple[np.ndarray, ...]:
    """For each of n texts: words, words scored by the longest n-gram, words that no other text has, and the score."""
    doc, order = own.text, len(counts)
    n_words = np.diff(own.first)
    outside = (total - n_words)[doc]
    value = np.where(counts[0] > 0, counts[0], 1) / np.where(counts[0] > 0, np.maximum(outside, 1), outside + 1)
    longest = np.minimum(np.arange(len(doc)) - own.first[:-1][doc], order - 1)
    used = np.zeros(len(doc), dtype=np.int64)
    for o in range(1, order):
        hit = counts[o] > 0
        context = np.concatenate([[1], counts[o - 1][:-1]])
        value = np.where(hit, counts[o] / np.maximum(context, 1), value)
        used = np.where(hit, o, used)
    micro = np.round((np.log(value) + (longest - used) * np.log(backoff)) * MICRO).astype(np.int64)
    unseen = (used == 0) & (counts[0] == 0)
    sums = np.zeros(n, dtype=np.int64)
    np.add.at(sums, doc, micro)
    hits = np.bincount(doc[(used == longest) & ~unseen], minlength=n)
    return n_words, hits, np.bincount(doc[unseen], minlength=n), sums


def score(df: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``id_column``, n_words, n_hits (words scored by the longest n-gram they end), n_unseen and log_score
    (the sum of natural logarithms, in millionths and rounded word by word, so that sums are exact).

    A word's score is count(n-gram) / count(context) for the longest n-gram ending at it that occurs in
    another text, times ``backoff`` for each shorter step; one that no other text has counts as one word more
    than all. A-Z are lower-cased. NULL and empty texts have no words and score 0; equal rows count for each
    other; other columns are ignored.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = exchange.write_blocks(df, id_column, text_column, BLOCK_BYTES, buckets=buckets)
    kind = df.schema[id_column].dataType.simpleString()
    n_blocks = stored.count()

    def request(docs: pa.RecordBatch, *replies: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        key, count = told(docs, order, replies).asked(steps(order)[len(replies)])
        return key, count.astype(np.uint32)

    for number, orders in enumerate(steps(order)):
        ranges = n_blocks * (BLOCK_BYTES // 8) * len(orders) // RANGE_KEYS
        replies = exchange.ask(stored, request, merge, ("uint32",), "int64", ranges, dense=True)
        if number + 1 < len(steps(order)):
            replies = exchange.write_buckets(replies, "replies", buckets)
        # A block that asked for nothing has no reply.
        stored = stored.join(replies.withColumnRenamed("parts", f"parts_{number}"), "block", "left")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, payload, *answers in zip(*batch.columns):
                docs = exchange.unpacked(payload.as_py())
                texts = told(docs, order, answers)
                for (row, n, own), counts in zip(texts.parts, texts.counts):
                    n_words, n_hits, n_unseen, sums = scored(own, n, counts, texts.total, backoff)
                    arrays = [docs.column(0).slice(row, n), *(pa.array(x) for x in (n_words, n_hits, n_unseen, sums))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_hits", "n_unseen", "log_score"])

    out = stored.mapInArrow(sums, f"id {kind}, n_words long, n_hits long, n_unseen long, log_score long")
    return out.withColumnRenamed("id", id_column)
