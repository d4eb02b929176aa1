import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefloom.functions.tokens import WordTokenizer
from prefloom.operators import vocabulary as vc

TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b c a", "x<|endoftext|>y[PAD] [PAD", "é ü \x1cz\x85 \x00", "<|endoftext|>", "[[PAD]] 漢 a\rb"]


def test_python_tasks_find_the_words_and_ids_of_the_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    tokenizer = WordTokenizer(pad_id=7, eos_id=-1, first_word_id=11)
    split, word_id = tokenizer.splitter(), tokenizer.hasher()
    rows = df.where("text IS NOT NULL").select("text", tokenizer.words(F.col("text")).alias("w"), tokenizer.encode(F.col("text")).alias("ids")).collect()
    for row in rows:
        assert [w.decode() for w in split(row.text.encode())] == row.w and [word_id(w.encode()) for w in row.w] == row.ids
    assert len(rows) == 7 and sum(r.ids.count(-1) for r in rows) == 2


def test_a_block_asks_once_for_each_id(spark):
    rows = spark.createDataFrame([(i, [5, 6, 5, None], 3) for i in range(300)] + [(300, None, 4), (301, [], 4)], "key int, ids array<bigint>, block long")
    batch = rows.select("block", "ids").toArrow().combine_chunks().to_batches()[0]
    found = pa.Table.from_batches(list(vc._distinct_ids([batch]))).to_pydict()
    assert found == {"block": [3, 3], "token_id": [5, 6]}


@pytest.mark.parametrize("ids, small", [(4, 0), (1, 0), (4, 1000)])
def test_texts_of_many_blocks_come_back(spark, monkeypatch, ids, small):
    monkeypatch.setattr(vc, "BLOCK_IDS", ids)
    texts = [TEXTS[i % len(TEXTS)] if i % 2 else f"word{i} the the {'of ' * (i % 7)}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    tokenizer = WordTokenizer()
    encoded = df.select("id", tokenizer.encode(F.col("text")).alias("tokens"))
    words = df.select("id", F.array_join(F.filter(tokenizer.words(F.col("text")), lambda w: ~w.isin(*tokenizer.specials)), " ").alias("text"))
    got = vc.decode(encoded, "id", "tokens", vc.build_vocabulary(df, "text"), small_vocabulary=small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, words.collect()))


def test_two_words_with_one_id_fail(spark, monkeypatch):
    monkeypatch.setattr(WordTokenizer, "hasher", lambda self: lambda word: 5)
    df = spark.createDataFrame([("one two",)], "text string")
    with pytest.raises(Exception, match="two words share an id: one, two"):
        vc.build_vocabulary(df, "text").collect()
