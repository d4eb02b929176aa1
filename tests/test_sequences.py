import pytest
from pyspark.sql import functions as F

from prefloom.functions import sequences as seq

LONGS = "array<bigint>"


def values(spark, data, *columns, schema="t array<bigint>"):
    df = spark.createDataFrame(data, "id int, " + schema)
    return [tuple(r)[1:] for r in df.select("id", *columns).orderBy("id").collect()]


def test_pad_and_fix_width(spark):
    data = [(0, [5, 6]), (1, []), (2, [1, 2, 3, 4])]
    t = F.col("t")
    got = values(spark, data, seq.pad(t, 3, 0, "left"), seq.pad(t, 3, 0, "right"), seq.fix_width(t, 3, 0))
    assert got[0] == ([0, 5, 6], [5, 6, 0], [5, 6, 0])
    assert got[1] == ([0, 0, 0],) * 3
    assert got[2] == ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3])
    with pytest.raises(ValueError, match="Invalid padding side"):
        seq.pad(t, 3, 0, "middle")


def test_label_masks_keep_their_length_without_padding(spark):
    t, n = F.col("t"), F.col("n")
    masked = seq.mask_pad_labels(seq.mask_query_labels(t, n), 0)
    data = [(0, [7, 8, 9], 1), (1, [7, 8, 0], 2), (2, [0, 0], 0), (3, [7], 5)]
    got = values(spark, data, masked, seq.response_only(t, n, 0), schema="t array<bigint>, n int")
    assert got[0] == ([-100, 8, 9], [0, 8, 9])
    assert got[1] == ([-100, -100, -100], [0, 0, 0])
    assert got[2] == ([-100, -100], [0, 0])
    assert got[3] == ([-100], [0])


def test_shift_split_and_attention(spark):
    t = F.col("t")
    prompt, response = seq.split_context(t, 2)
    got = values(spark, [(0, [1, 2, 3, 0]), (1, [])], seq.shift_next_token(t, t), prompt, response, seq.attention_mask(t, 0))
    assert [tuple(p) for p in got[0][0]] == [(1, 2), (2, 3), (3, 0)]
    assert got[0][1:] == ([1, 2], [3, 0], [True, True, True, False])
    assert got[1] == ([], [], [], [])


def test_first_true_index(spark):
    got = values(spark, [(0, [2, 1, 1]), (1, [2, 2]), (2, [1])], seq.first_true_index(F.col("t"), F.lit(1).cast("bigint")))
    assert got == [(1,), (2,), (0,)]


def test_score_at_first_eos(spark):
    data = [(0, [5, 1, 1], [0.1, 0.2, 0.3]), (1, [5, 5, 5], [0.1, 0.2, 0.3]), (2, [1, 5, 5], [0.7, 0.2, 0.3])]
    s, t = F.col("s"), F.col("t")
    got = values(spark, data, seq.score_at_eos(s, t, 1), seq.score_at_eos(s, t, 1, strict_compat=True), schema="t array<bigint>, s array<double>")
    assert got == [(0.2, 0.2), (-1.0, -1.0), (0.7, -1.0)]


def test_terminal_reward(spark):
    scores = [0.1, 0.2, 0.3]
    data = [(0, [5, 1, 0], scores), (1, [5, 6, 7], scores), (2, [0, 0, 0], scores), (3, [1, 0, 0], scores), (4, [5, 6, 1], scores)]
    got = values(spark, data, seq.terminal_reward(F.col("s"), F.col("t"), 0, 1), schema="t array<bigint>, s array<double>")
    assert got == [([0.0, 0.2, 0.0],), ([0.0, 0.0, -1.0],), ([0.0, 0.0, 0.0],), ([0.1, 0.0, 0.0],), ([0.0, 0.0, 0.3],)]


def test_spread_and_zip(spark):
    rows = spark.createDataFrame([([True, False], [1, 2])], "m array<boolean>, t array<bigint>")
    row = rows.select(seq.spread_advantage(F.lit(2.5), F.col("m")).alias("a"), seq.zip_records(m=F.col("m"), t=F.col("t")).alias("z")).first()
    assert row.a == [2.5, 0.0] and [tuple(x) for x in row.z] == [(True, 1), (False, 2)]
