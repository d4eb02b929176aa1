"""Token ids back to text with a vocabulary table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions.tokens import SLICE_BYTES, WordTokenizer, slices, text_sizes
from prefloom.operators.skew import HOT_ROWS, bounded_sample, frequent_keys, join_unique
from prefloom.session import cut_lineage

# Vocabularies up to this many entries and bytes are sent to every task.
SMALL_VOCABULARY = 1_000_000
SMALL_VOCABULARY_BYTES = 64 << 20
# Sequences looked at to find tokens that make up a large share of a data set.
SAMPLE_SEQUENCES = 2_000
# Ids of the rows that are named together by a larger vocabulary.
BLOCK_IDS = 1 << 19
# Texts whose distinct words a task sends at a time.
WORDS_BYTES = 16 << 20


def build_vocabulary(texts: DataFrame, text: str, tokenizer: WordTokenizer = WordTokenizer()) -> DataFrame:
    """(token_id, token) of every word in the texts; two words with one id fail the query.

    Tasks send the distinct words of some megabytes of texts at a time, each with its id.
    """
    split, word_id = tokenizer.splitter(), tokenizer.hasher()

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = set(), 0

        def out() -> pa.RecordBatch:
            ids = pa.array(np.fromiter(map(word_id, own), np.int64, len(own)))
            return pa.RecordBatch.from_arrays([ids, pa.array(own, pa.binary()).cast(pa.string())], ["token_id", "token"])

        for batch in batches:
            sizes = text_sizes(batch.column(0))
            for start, end in slices(sizes, SLICE_BYTES):
                for t in batch.column(0).slice(start, end - start).cast(pa.binary()).to_pylist():
                    own.update(split(t or b""))
                size += int(sizes[start:end].sum())
                if size >= WORDS_BYTES:
                    yield out()
                    own, size = set(), 0
        if own:
            yield out()

    ids = texts.select(F.col(text).cast("string")).mapInArrow(words, "token_id long, token string")
    return ids.groupBy("token_id").agg(_only_word().alias("token"))


def _only_word():
    first, last = F.min("token"), F.max("token")
    message = F.concat(F.lit("two words share an id: "), first, F.lit(", "), last)
    return F.when(first == last, first).otherwise(F.raise_error(message))


def decode(
    df: DataFrame,
    key: str,
    tokens: str,
    vocabulary: DataFrame,
    specials: Sequence[int] = (0, 1),
    out: str = "decoded",
    small_vocabulary: int = SMALL_VOCABULARY,
    min_hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The text of each token array without special tokens, words joined by blanks; (key, out), row for row.

    A NULL array gives NULL; ids that are NULL or have no word are left out; keys may repeat. A vocabulary
    of at most ``small_vocabulary`` entries (and a size to match) is looked up inside each task without a
    shuffle, a larger one is joined to the distinct ids of blocks of rows; both give the same rows.
    """
    plain = vocabulary.where(F.col("token").isNotNull() & ~F.col("token_id").isin(*specials))
    entries, size = plain.agg(F.count("*"), F.sum(F.octet_length("token"))).first()
    if entries <= small_vocabulary and (size or 0) <= SMALL_VOCABULARY_BYTES:
        return df.select(key, _lookup(plain.select("token_id", "token").toArrow(), df)(F.col(tokens)).alias(out))
    # A block of rows asks once for each of its ids.
    rows = cut_lineage(_blocks(df.select(F.col(key).alias("key"), F.col(tokens).cast("array<bigint>").alias("ids"))))
    hot = []
    if rows.select("block").distinct().count() > min_hot_rows:  # else no id is asked for so often
        sample, _, fraction = bounded_sample(rows.select("ids"), SAMPLE_SEQUENCES)
        sampled = sample.agg(F.sum(F.array_size("ids"))).first()[0] or 0
        hot = frequent_keys(sample.select(F.explode("ids").alias("token_id")), "token_id", sampled, fraction, min_hot_rows)
    asked = rows.select("block", F.array_distinct("ids").alias("ids")).mapInArrow(_distinct_ids, "block long, token_id long")
    names = join_unique(asked, plain, "token_id", hot, ["block"], how="inner").select(F.col("block").alias("asking"), "token_id", "token")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])

    def name(rows: pa.Table, names: pa.Table) -> pa.Table:
        found = _named(rows.column("ids").combine_chunks(), *_sorted(names))
        return pa.table([rows.column("key"), found], names=[key, out])

    return rows.groupBy("block").cogroup(names.groupBy("asking")).applyInArrow(name, schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, ids) and the number of their block: consecutive rows of a batch with ``BLOCK_IDS`` ids at most,
    or a longer row alone."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in slices(sizes, BLOCK_IDS):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(end - start, number))], ["key", "ids", "block"])
                number += 1

    return rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())]))


def _distinct_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, token_id) once for each run of a block's rows in a batch."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(block)]):
            ids = np.unique(batch.column(1).slice(start, end - start).flatten().drop_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block[start])), pa.array(ids, pa.int64())], ["block", "token_id"])


def _sorted(vocabulary: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids in ascending order, and their words."""
    kept = vocabulary.filter(pc.is_valid(vocabulary.column("token_id"))).sort_by("token_id").combine_chunks()
    ids = kept.column("token_id").to_numpy().astype("int64")
    return ids, pa.concat_arrays(kept.column("token").cast(pa.string()).chunks or [pa.array([], pa.string())])


def _named(batch: pa.Array, ids: np.ndarray, words: pa.Array) -> pa.Array:
    """The texts of token arrays, all looked up at once."""
    length = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    flat = batch.flatten()
    known = np.zeros(len(flat), dtype=bool)
    spots = np.zeros(len(flat), dtype=np.int64)
    if len(ids):
        tokens = flat.fill_null(0).to_numpy(zero_copy_only=False)
        spots = np.minimum(np.searchsorted(ids, tokens), len(ids) - 1)
        known = (ids[spots] == tokens) & flat.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(known)])
    offsets = before[np.concatenate([[0], np.cumsum(length)])]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(spots[known])))
    return pc.if_else(batch.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))


def _lookup(vocabulary: pa.Table, df: DataFrame):
    table = df.sparkSession.sparkContext.broadcast(_sorted(vocabulary))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, words = table.value
        for batch in batches:
            yield _named(batch, ids, words)

    return run
