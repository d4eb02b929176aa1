import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prefloom.catalog.subword_queries import TOKENIZER as SLICED
from prefloom.functions import subwords
from prefloom.functions.subwords import merge_pairs


def test_slices_cover_all_rows_and_stay_small():
    sizes = np.array([3, 4, 9, 0, 0, 2, 5, 1])
    assert list(subwords.slices(sizes, 7)) == [(0, 2), (2, 3), (3, 7), (7, 8)]
    assert list(subwords.slices(sizes[:0], 7)) == []
    assert list(subwords.text_sizes(pa.array(["é", None, ""]))) == [2, 0, 0]


def test_batches_beyond_a_slice_come_back_whole(spark):
    long = "The ring, then " * (subwords.SLICE_BYTES // 10)
    texts = [(i, [long, None, "", "été ☃ ring\n"][i % 4]) for i in range(9)]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    encoded = df.select("id", "text", SLICED.encode(F.col("text")).alias("ids"))
    assert {(r.id, r.text == r.back) for r in encoded.select("id", "text", SLICED.decode(F.col("ids")).alias("back")).collect()} == {
        (i, True) for i, _ in texts
    }


def test_prompts_beyond_a_slice_are_cut_row_by_row(spark):
    posts = [(i, ["ring " * (subwords.SLICE_BYTES // 4), None, "", "a\nb"][i % 4]) for i in range(9)]
    df = spark.createDataFrame(posts, "id int, post string").coalesce(1)
    fitted = df.select("id", SLICED.fit_prompt_ids("{post} end", {"post": F.col("post")}, 20).alias("f")).collect()
    own = SLICED.encoder()
    expected = {i: own.fit("", "None" if p is None else p, " end", 20, "\n") for i, p in posts}
    assert {r.id: (r.f.prompt, r.f.ids) for r in fitted} == expected


def test_words_kept_by_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(subwords, "CACHED_SIZE", 1000)
    own, fresh = SLICED.encoder(), SLICED.encoder()
    words = [f"w{i}{'x' * (i % 50)}" for i in range(300)] + ["y" * 5000]
    for word in words:
        assert own.word(word) == merge_pairs(word.encode(), fresh.ranks)
        assert sum(len(w) + len(ids) for w, ids in own.known.items()) <= 1000 or len(own.known) == 1
