import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import frame, lower

from prefloom.llm import ranked_search
from prefloom.llm.ranked_search import Postings, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _brute(docs, items, k):
    split = [(i, TERM.findall(lower(t))) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    holding = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in split:
            tf, m = Counter(w), 75 + 25 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in TERM.findall(lower(text))
                if tf[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def _texts(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "X1", "漢"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("few, shard, item_bytes", [(256, 16 << 20, 4 << 20), (1, 2000, 300)])
def test_search_agrees_with_brute_force(spark, monkeypatch, few, shard, item_bytes):
    monkeypatch.setattr(ranked_search, "FEW_POSTINGS", few)
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    texts = _texts(1, 150) + ["w1 w2 w1"] * 40 + [None, "", "...", "W1-w1_w5", "w3 " * 20_000]
    ids = [*range(len(texts) - 3), None, None, 4]
    asked = [(1, "w1 w2 w2 W50"), (2, None), (3, ""), (4, "nowhere"), (1, "w1"), (None, "É w7; X1"), (6, "w1 w2 w1")]
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in asked], "item_id long, text string, rank int, score string")
    docs = frame(spark, texts, ids).withColumnRenamed("size", "score").withColumnRenamed("block", "item_id").repartition(5)
    for k in (1, 20):
        found = ranked(docs, items, k, item_bytes=item_bytes)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted([tuple(r) for r in found.collect()], key=repr) == _brute(list(zip(ids, texts)), asked, k)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z z z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [r["doc_id"] for r in ranked(docs, items).orderBy("rank").collect()] == ["a", "b", None]


def test_nothing_to_ask_or_to_find(spark):
    docs, items = frame(spark, ["w1"]), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked(docs.where("false"), items).count() == 0
    assert ranked(docs, items.where("false")).count() == 0


def test_largest_impact_of_every_range():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 17, 64]
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.concatenate([np.sort(rng.choice(100, n, replace=False)) for n in sizes])
    impact = rng.integers(0, 9, len(doc))
    lists = Postings(first, doc, impact, 100)
    for a, b in zip(first, first[1:]):
        for low in range(a, b):
            high = np.arange(low + 1, b + 1)
            place = lists.largest(np.full(len(high), low), high)
            assert impact[place].tolist() == [impact[low:h].max() for h in high]


def test_few_documents_are_scored_where_bounds_decide():
    """One document far above the rest: the search must not look at all of them."""
    documents, terms = 20_000, 4
    doc = np.tile(np.arange(documents), terms)
    impact = np.tile(np.random.default_rng(1).integers(1, 100, documents), terms)
    impact[doc == 777] = 1000
    lists = Postings(np.arange(terms + 1) * documents, doc, impact, documents)
    seen, inner = [], np.searchsorted
    try:
        np.searchsorted = lambda a, v, **k: (seen.append(np.size(v)), inner(a, v, **k))[1]
        score, found = lists.search(np.arange(terms), np.ones(terms, np.int64), 1)
    finally:
        np.searchsorted = inner
    assert (score[0], found[0]) == (4000, 777) and sum(seen) < 1000
