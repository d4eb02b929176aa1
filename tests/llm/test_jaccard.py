import random

import pytest

import brute
from prefloom.llm import exchange, jaccard_join
from prefloom.llm.jaccard_join import components, jaccard_classes


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([1, 3, 5, 12, 40, 90, 200]))] for _ in range(14)]
    common = [word() for _ in range(30)]
    out = [None, "", " \n", "One", "one", "one two three", "ONE two\nthree"]
    for b in base:
        for _ in range(r.choice([1, 2, 6])):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w + (common if r.random() < 0.3 else [])))
    return out


@pytest.mark.parametrize("hot,seed", [(1024, 1), (1024, 2), (2, 3)])
def test_classes_against_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = near_copies(seed)
    got = jaccard_classes(brute.frame(spark, rows)).orderBy("doc_id").collect()
    first, sizes = brute.classes(rows)
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == [f + 1 for f in first]
    assert [r.is_first for r in got] == [f == i for i, f in enumerate(first)]


def test_null_and_repeated_ids(spark):
    rows = ["a b c d e", "a b c d e", "A b c d e", "x", None]
    got = jaccard_classes(brute.frame(spark, rows, [None, 5, 5, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.is_first) for r in got) == sorted(
        [("None", "5", False), ("5", "5", True), ("5", "5", False), ("None", "None", True), ("None", "None", True)]
    )
    assert jaccard_classes(brute.frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert dict(map(tuple, got)) == brute.reach(edges) and len(got) == len(brute.reach(edges))


def test_more_than_128_partitions(spark):
    rows = [f"text {i % 350} of a table in many parts" for i in range(600)]
    got = jaccard_classes(brute.frame(spark, rows).repartition(300)).orderBy("doc_id").collect()
    first, sizes = brute.classes(rows)
    assert [(r.n_shingles, r.component_id) for r in got] == [(s, f + 1) for s, f in zip(sizes, first)]
    assert sum(r.is_first for r in got) == len(set(first))


def test_numbers_of_rows(spark):
    rows = brute.frame(spark, [None, "a", ""] * 100).repartition(7)
    stored = exchange.write_blocks(rows, "doc_id", "text", block_rows=4).collect()
    sizes = [exchange.unpacked(r.payload).num_rows for r in stored]
    assert sum(sizes) == 300 and max(sizes) == 4
    numbers = [int(x) for r, n in zip(stored, sizes) for x in exchange.row_numbers(r.block, 0, n)]
    assert len(set(numbers)) == 300
    last = (1 << 63 - exchange.ROW_BITS) - 1
    assert int(exchange.row_numbers(last, (1 << exchange.ROW_BITS) - 1, 1)[0]) == (1 << 63) - 1
