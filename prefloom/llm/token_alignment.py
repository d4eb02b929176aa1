"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Two tokenizations of one text are two ascending lists of byte ends. Merging them walks from overlap to
overlap: at each step the token that ends first is done. Diagonals of the merge, found by binary search in
both lists at once, divide the walk into pieces of equal work that know nothing of each other
(``piece_bounds``, ``piece_overlaps``). Where both tokens end together a group ends; a piece that begins just
behind an end which its neighbour has already taken is stitched to it there (``Aligned``).

Documents are aligned some hundred kilobytes at a time; the token ids of linked pairs are kept as one row a slice in
the shared folder, in row groups of ``GROUP_BYTES``: Spark's reader holds up to 4096 rows of a row group at once, and
the writer a whole one. Pairs are counted per task before they are shuffled. The counts go back to the slices by
broadcasts of at most ``PAIRS_AT_ONCE`` pairs, a further lot of pairs being one more pass over the slices.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.exchange import BLOCK_BITS, row_numbers
from prefloom.session import scratch_path

SLICE_BYTES = 1 << 18
PIECE = 1 << 16  # steps of the merge to a piece
GROUP_BYTES = 1 << 23  # slices that stand together in a file, which are written and read at once
PAIRS_AT_ONCE = 2_000_000  # pairs of a broadcast: 17 bytes each
PAIRS_HELD = 1 << 19  # distinct pairs that a counting task holds before it passes them on

# Fixed values of byte_bpe_50k.json: its word pattern, and the characters that stand for bytes in its
# vocabulary: printable ones for themselves, the rest from 256 on.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_OF = {**{chr(b): b for b in _PRINTABLE}, **{chr(256 + i): b for i, b in enumerate(_OTHERS)}}
# Beyond these characters, whose classes all versions of Unicode share, the tokenizer itself cuts the words.
COMMON = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")


class BytePairs:
    """A byte-level BPE tokenizer from its JSON file: ids of texts and the bytes of each id."""

    def __init__(self, path: str):
        self.path, self.fast, self._whole = path, None, None
        with open(path, encoding="utf-8") as file:
            vocabulary, merges = itemgetter("vocab", "merges")(json.load(file)["model"])
        self.bytes = [b""] * self.whole.get_vocab_size(with_added_tokens=True)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(BYTE_OF[c] for c in token) if all(c in BYTE_OF for c in token) else token.encode()
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        singles = sorted(vocabulary[c] for c in BYTE_OF)
        # Where the ids are the ranks of the merges, another library does the same merges several times faster.
        self.ranked = 256 + len(merged) if singles + merged == list(range(256 + len(merged))) else 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "fast": None, "_whole": None}

    @property
    def whole(self):
        """The tokenizer itself, which a worker loads when it first meets a text that needs it."""
        if self._whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return self._whole

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none where they do not give its bytes."""
        if self.ranked and COMMON.fullmatch(text):
            if self.fast is None:
                import tiktoken

                ranks = {self.bytes[i]: i for i in range(self.ranked)}
                self.fast = tiktoken.Encoding("pairs", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ids = self.whole.encode(text, add_special_tokens=False).ids
        same = b"".join([self.bytes[i] for i in ids]) == text.encode()
        return np.array(ids if same else [], dtype=np.int64)


class Pieces:
    """A sentence-piece tokenizer: ids of texts, which get a leading space, and the bytes of each id."""

    def __init__(self, path: str):
        self.path, self._whole = path, None
        names = self.whole.id_to_piece(list(range(self.whole.get_piece_size())))
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.whole.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_whole": None}

    @property
    def whole(self):
        if self._whole is None:
            import sentencepiece

            self._whole = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._whole

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none where they do not give the bytes of a space and the text."""
        out = []
        for text, ids in zip(texts, self.whole.encode(texts, num_threads=1)):
            same = b"".join([self.bytes[i] for i in ids]) == b" " + text.encode()
            out.append(np.array(ids if same else [], dtype=np.int64))
        return out


def piece_bounds(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals of the merge of ``a`` and ``b`` cut them, ``piece`` steps apart; of equal ends a's comes first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        past = np.zeros(len(diagonal), dtype=bool)
        past[open_] = a[middle[open_]] > b[(diagonal - middle)[open_] - 1]
        low, high = np.where(open_ & ~past, middle + 1, low), np.where(open_ & past, middle, high)
    return low, diagonal - low


def piece_overlaps(
    a: np.ndarray, b: np.ndarray, a_from: int, a_to: int, b_from: int, b_to: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps that end in one piece: at each end of a token of A the token of B around it, and at each end
    of a token of B that is no end in A's piece the token of A around it: rows (A's, B's number, whether B ended)."""
    own_a, own_b = a[a_from:a_to], b[b_from:b_to]
    in_b = b_from + np.searchsorted(own_b, own_a)
    in_a = np.searchsorted(own_a, own_b)
    alone = np.ones(len(own_b), dtype=bool)
    some = in_a < len(own_a)
    alone[some] = own_a[in_a[some]] != own_b[some]
    first = np.concatenate([np.arange(a_from, a_to), a_from + in_a[alone]])
    second = np.concatenate([in_b, b_from + np.flatnonzero(alone)])
    return first, second, np.repeat([False, True], [len(own_a), int(alone.sum())])


@dataclass
class Aligned:
    """Tokens of consecutive texts over the same bytes: ends, the overlaps, and the token pairs that end together."""

    a: np.ndarray
    b: np.ndarray
    piece: int = PIECE
    overlap_a: np.ndarray = field(init=False)
    overlap_b: np.ndarray = field(init=False)
    link_a: np.ndarray = field(init=False)  # numbers of the last token of A in each group
    link_b: np.ndarray = field(init=False)

    def __post_init__(self):
        at_a, at_b = piece_bounds(self.a, self.b, self.piece)
        parts = []
        for i in range(len(at_a) - 1):
            first, second, b_ended = piece_overlaps(self.a, self.b, at_a[i], at_a[i + 1], at_b[i], at_b[i + 1])
            if at_a[i] and at_b[i] < len(self.b) and self.a[at_a[i] - 1] == self.b[at_b[i]]:
                # Stitching: this end of B is the last end of A in the piece before, which has emitted the overlap.
                keep = ~(b_ended & (second == at_b[i]))
                first, second = first[keep], second[keep]
            parts.append((first, second))
        empty = np.zeros(0, np.int64)
        self.overlap_a = np.concatenate([p[0] for p in parts] or [empty])
        self.overlap_b = np.concatenate([p[1] for p in parts] or [empty])
        together = self.a[self.overlap_a] == self.b[self.overlap_b]
        self.link_a, self.link_b = np.sort(self.overlap_a[together]), np.sort(self.overlap_b[together])

    def group_of(self, link: np.ndarray, n: int) -> np.ndarray:
        closed = np.zeros(n, dtype=np.int64)
        closed[link] = 1
        return np.cumsum(closed) - closed


@dataclass
class Slice:
    """Consecutive documents with their tokens; documents without tokens have counts of 0."""

    rows: pa.RecordBatch
    ids_a: np.ndarray
    ids_b: np.ndarray
    first_a: np.ndarray  # where each document's tokens begin, one more at the end
    first_b: np.ndarray
    pairs: Aligned

    @property
    def first_group(self) -> np.ndarray:
        return np.searchsorted(self.pairs.link_a, self.first_a)


def slices(batches: Iterable[pa.RecordBatch], tokenizers: tuple[BytePairs, Pieces], slice_bytes: int, piece: int) -> Iterator[Slice]:
    one, two = tokenizers
    bytes_a, bytes_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (one, two))
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, slice_bytes + (upto[at - 1] if at else 0), side="right")))
            texts = [t or "" for t in batch.column("text").slice(at, to - at).to_pylist()]
            tokens_a, tokens_b = [], []
            for text, ids_b in zip(texts, two.encode(texts)):
                ids_a = one.encode(" " + text) if text and len(ids_b) else ids_b[:0]
                fits = len(ids_a) > 0 and int(bytes_a[ids_a].sum()) == int(bytes_b[ids_b].sum())
                tokens_a.append(ids_a if fits else ids_a[:0])
                tokens_b.append(ids_b if fits else ids_b[:0])
            ids_a, ids_b = np.concatenate(tokens_a), np.concatenate(tokens_b)
            ends = (np.cumsum(sizes[ids]) for sizes, ids in ((bytes_a, ids_a), (bytes_b, ids_b)))
            first_a, first_b = (np.concatenate([[0], np.cumsum([len(t) for t in ts])]).astype(np.int64) for ts in (tokens_a, tokens_b))
            yield Slice(batch.slice(at, to - at), ids_a, ids_b, first_a, first_b, Aligned(*ends, piece))
            at = to


def _cells(size: int, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids and a mark behind each (0: none), padded with zero bytes to 8; and their digits."""
    digits = [str(i).encode() for i in range(size)]
    cells = b"".join([(d + bytes([m] if m else [])).ljust(8, b"\0") for d in digits for m in marks])
    return np.frombuffer(cells, dtype=np.uint64).reshape(size, len(marks)), np.array([len(d) for d in digits])


def digests(own: Slice, cells_a, cells_b) -> list[str]:
    """For each document the SHA-256 of its groups "a1,a2|b1;a3|b2,b3"; empty without tokens."""
    (text_a, digits_a), (text_b, digits_b) = cells_a, cells_b
    pairs, n_a, n_b = own.pairs, len(own.ids_a), len(own.ids_b)
    last_a, last_b = np.zeros(n_a, dtype=np.int64), np.zeros(n_b, dtype=np.int64)
    last_a[pairs.link_a], last_b[pairs.link_b] = 1, 1
    before_b = np.concatenate([[0], pairs.link_b + 1])  # tokens of B before each group
    place_a = np.arange(n_a) + before_b[np.cumsum(last_a) - last_a]
    place_b = np.arange(n_b) + (pairs.link_a + 1)[np.cumsum(last_b) - last_b]
    last_b[own.first_b[1:][np.diff(own.first_b) > 0] - 1] = 2  # no mark behind a document's last token
    line = np.empty(n_a + n_b, dtype=np.uint64)
    line[place_a], line[place_b] = text_a[own.ids_a, last_a], text_b[own.ids_b, last_b]
    body = memoryview(line.tobytes().translate(None, b"\0"))
    upto_a = np.concatenate([[0], np.cumsum(digits_a[own.ids_a] + 1)])
    upto_b = np.concatenate([[0], np.cumsum(digits_b[own.ids_b] + (last_b < 2))])
    edges = (upto_a[own.first_a] + upto_b[own.first_b]).tolist()
    return [hashlib.sha256(body[s:e]).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])]


def _named(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), df.schema[id_column].dataType.simpleString()


def token_groups(
    df: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    slice_bytes: int = SLICE_BYTES,
    piece: int = PIECE,
) -> DataFrame:
    """One row per group of each document: ``id_column``, group_no (from 0), start and end (bytes of a space and the
    text), a and b (ids). Documents without tokens (see ``alignment``) give no rows."""
    docs, kind = _named(df, id_column, text_column)
    shared = df.sparkSession.sparkContext.broadcast((BytePairs(path_a), Pieces(path_b)))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in slices(batches, shared.value, slice_bytes, piece):
            link_a, link_b = own.pairs.link_a, own.pairs.link_b
            if not len(link_a):
                continue
            n = np.diff(own.first_group)
            doc = np.repeat(np.arange(len(n)), n)
            ends = own.pairs.a[link_a]
            starts = np.concatenate([[0], ends[:-1]])
            base = starts[np.minimum(own.first_group[:-1], len(starts) - 1)][doc]
            a, b = (
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], link + 1]), pa.int32()), pa.array(ids, pa.int32()))
                for link, ids in ((link_a, own.ids_a), (link_b, own.ids_b))
            )
            number = np.arange(len(doc)) - own.first_group[:-1][doc]
            arrays = [own.rows.column("id").take(pa.array(doc)), pa.array(number), pa.array(starts - base), pa.array(ends - base), a, b]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "group_no", "start", "end", "a", "b"])

    schema = f"id {kind}, group_no long, start long, end long, a array<int>, b array<int>"
    return docs.mapInArrow(rows, schema).withColumnRenamed("id", id_column)


def alignment(
    df: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    slice_bytes: int = SLICE_BYTES,
    piece: int = PIECE,
    pairs_at_once: int = PAIRS_AT_ONCE,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Columns ``id_column``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``df``.

    A is a byte-level BPE file and encodes a space and the text, B a sentence-piece model, which adds the space.
    A link is a token of A and one of B that end at the same byte; a pair of ids counts its links in all rows.
    n_best counts the links whose pair has the largest count of all pairs with that id of B (ties are best too),
    count_sum adds the counts of all links. NULL and empty texts and those that either tokenizer does not give
    back byte by byte have zeros and an empty digest. Ids may be NULL or repeat; other columns are ignored; no
    rows give no rows.
    """
    spark = df.sparkSession
    docs, kind = _named(df, id_column, text_column)
    both = BytePairs(path_a), Pieces(path_b)
    size_a, size_b = (len(t.bytes) for t in both)
    shared = spark.sparkContext.broadcast(both)
    key_type = np.uint32 if size_a * size_b <= 1 << 32 else np.uint64
    counts = ["n_a", "n_b", "n_groups"]

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _cells(size_a, b",|"), _cells(size_b, b",;\0")
        number = TaskContext.get().partitionId() << BLOCK_BITS
        for own in slices(batches, shared.value, slice_bytes, piece):
            keys = own.ids_a[own.pairs.link_a] * size_b + own.ids_b[own.pairs.link_b]
            whole = pa.array([0, own.rows.num_rows], pa.int32())
            each = [np.diff(x) for x in (own.first_a, own.first_b, own.first_group)]
            lists = [own.rows.column("id"), *map(pa.array, each), pa.array(digests(own, *cells), pa.string())]
            arrays = [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(whole, x) for x in lists)]
            arrays.append(pa.array([keys.astype(key_type).tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["slice", "id", *counts, "digest", "links"])
            number += 1

    path = scratch_path(spark, "aligned")
    schema = f"slice long, id array<{kind}>, {', '.join(f'{c} array<long>' for c in counts)}, digest array<string>, links binary"
    groups = {"parquet.block.size": group_bytes, "parquet.page.size": group_bytes}
    looks = {f"parquet.page.size.row.check.{k}": rows for k, rows in (("min", 1), ("max", 8))}  # rows between two looks at the size
    docs.mapInArrow(align, schema).write.options(compression="zstd", **groups, **looks).parquet(path)
    stored = spark.read.parquet(path)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(key), dtype=np.int64)
            np.add.at(n, back, np.concatenate([n for _, n in held]))
            return key, n

        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for body in batch.column(0):
                held.append(np.unique(np.frombuffer(body.as_py(), key_type), return_counts=True))
                if sum(len(k) for k, _ in held) > PAIRS_HELD:
                    held = [merged()]
                    if len(held[0][0]) > PAIRS_HELD // 2:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())

    pairs = stored.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair") % size_b)) == F.col("n")
    counted = scratch_path(spark, "pairs")
    pairs.select("pair", "n", best.alias("best")).write.parquet(counted)
    pairs = spark.read.parquet(counted)
    lots = max(1, -(-pairs.count() // pairs_at_once))
    result = None
    for lot in range(lots):
        own = pairs if lots == 1 else pairs.where(F.pmod(F.xxhash64("pair"), F.lit(lots)) == lot)
        own = own.toArrow()
        key, order = (lambda k: (np.sort(k), np.argsort(k)))(own.column("pair").to_numpy())
        known = spark.sparkContext.broadcast(
            (key.astype(key_type), own.column("n").to_numpy()[order], own.column("best").to_numpy(zero_copy_only=False)[order])
        )

        def look_up(batches: Iterable[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            key, n, best = known.value
            for batch in batches:
                for row in range(batch.num_rows):
                    part = {c: batch.column(c).slice(row, 1).flatten() for c in ("id", *counts, "digest")}
                    link = np.frombuffer(batch.column("links")[row].as_py(), key_type)
                    place = np.minimum(np.searchsorted(key, link), max(len(key) - 1, 0))
                    found = key[place] == link if len(key) else np.zeros(len(link), bool)
                    edge = np.concatenate([[0], np.cumsum(part["n_groups"].to_numpy())])
                    sums = []
                    for value in (best, n):
                        each = np.where(found, value[place], 0) if len(key) else np.zeros(len(link))
                        sums.append(np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[edge]))
                    number = row_numbers(batch.column("slice")[row].as_py(), 0, len(part["id"]))
                    arrays = [pa.array(number), *part.values(), *map(pa.array, sums)]
                    yield pa.RecordBatch.from_arrays(arrays, ["row", *part, "n_best", "count_sum"])

        rows = f"row long, id {kind}, {', '.join(f'{c} long' for c in counts)}, digest string, n_best long, count_sum long"
        found = stored.mapInArrow(look_up, rows)
        result = found if result is None else result.unionByName(found)
    if lots > 1:
        sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
        result = result.groupBy("row").agg(*(F.first(c).alias(c) for c in ("id", *counts, "digest")), *sums)
    return result.select(
        F.col("id").alias(id_column), *counts, F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("digest").alias("groups_sha256")
    )
