"""Scores of texts: compared with a plain count at every order, and what a run leaves on disk."""

import math
import os
import random
import re
from collections import Counter

import pytest

import brute
from prefloom.llm import lm_scoring
from prefloom.llm.lm_scoring import MICRO, score
from prefloom.session import shared_dir


def backoff(texts, order):
    """(n_words, n_hits, n_unseen, log_score) of each text by the counts of all other texts."""
    rows = [re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t or "")) for t in texts]
    own = [Counter(tuple(w[i : i + o]) for o in range(1, order + 1) for i in range(len(w) - o + 1)) for w in rows]
    every = sum(own, Counter())
    total = sum(map(len, rows))
    out = []
    for w, mine in zip(rows, own):
        hits = unseen = micro = 0
        outside = total - len(w)
        for i in range(len(w)):
            longest = min(i + 1, order)
            for o in range(longest, 0, -1):
                gram = tuple(w[i + 1 - o : i + 1])
                n = every[gram] - mine[gram]
                if n:
                    break
            context = every[gram[:-1]] - mine[gram[:-1]] if o > 1 else outside
            hits += o == longest and n > 0
            unseen += n == 0
            value = n / context if n else 1 / (outside + 1)
            micro += round((math.log(value) + (longest - o) * math.log(0.4)) * MICRO)
        out.append((len(w), hits, unseen, micro))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_bytes", [200, 4 << 20])
def test_scores_against_plain_counts(spark, monkeypatch, order, block_bytes):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 100)
    r = random.Random(order)
    word = lambda: r.choice(["a", "B", "b", "ü", "c1", f"w{r.randrange(30)}"])
    rows = [None, "", " \n", "a", "only here 1", *(" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(40))]
    rows += [rows[10], rows[11] + " B a", "nowhere else are these words"]
    got = score(brute.frame(spark, rows), order=order).orderBy("doc_id").collect()
    for row, want in zip(got, backoff(rows, order), strict=True):
        assert (row.n_words, row.n_hits, row.n_unseen) == want[:3]
        assert abs(row.log_score - want[3]) <= max(1, row.n_words // 50)  # rounding halves


def test_rows_without_words_in_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1)
    got = score(spark.createDataFrame([(1, None), (2, "x y z"), (3, "p q"), (None, "X Y Z")], "doc_id long, text string"))
    assert sorted((r.n_words, r.n_hits) for r in got.collect()) == [(0, 0), (2, 0), (3, 3), (3, 3)]


def test_disk_of_a_run(spark):
    """Order 3 had taken 2.3 bytes for each byte of these texts: keys of all n-grams, and the texts twice."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(words[int(len(words) * r.random() ** 4)] for _ in range(2_000)) for _ in range(400)]
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    folders.append(shared_dir(spark))

    def used():
        return sum(os.path.getsize(os.path.join(at, f)) for d in folders for at, _, files in os.walk(d) for f in files)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    before = used()
    scores = score(rows)
    scores.write.format("noop").mode("overwrite").save()
    assert used() - before < 1.9 * sum(map(len, texts))
