import random

import numpy as np
import pytest

import brute
from prefloom.llm import substring_dedup, suffix_array_dedup
from prefloom.llm.substring_dedup import SuffixAutomaton, remove_seen
from prefloom.llm.suffix_array_dedup import insert_columns, remove_repeats


def texts(seed, alphabet="abc déf\n", passages=6):
    r = random.Random(seed)
    shared = ["".join(r.choice(alphabet) for _ in range(r.randint(20, 90))) for _ in range(passages)]
    out = [None, "", " ", "ab", "a" * 300, "ab" * 150, "a" * 300]
    for _ in range(40):
        parts = [r.choice(shared) if r.random() < 0.5 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5)]
        out.append("".join(parts))
    return out + out[10:14]


@pytest.mark.parametrize("length", [12, 40])
def test_bytes_against_brute_force(spark, length):
    rows = texts(length)
    got = remove_repeats(brute.frame(spark, rows), length).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.remove_bytes(rows, length)
    for r, text in zip(got, rows):
        raw = (text or "").encode()
        at, kept = 0, b""
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert bytes(r.kept) == kept + raw[at:]


@pytest.mark.parametrize("hot", [2, 4096])
def test_words_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = texts(3, "ab c d", 5)
    ids = [None if i == 9 else 7 if i in (3, 12) else i for i in range(len(rows))]
    got = remove_seen(brute.frame(spark, rows, ids), 5).collect()
    want = brute.remove_words(list(zip(ids, rows)), 5)
    mine = sorted([(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got])
    assert mine == sorted((str(i), *w) for i, w in zip(ids, want))


def test_hot_keys_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix_array_dedup, "HOT", 1)
    rows = texts(5)
    got = remove_repeats(brute.frame(spark, rows), 30, keep_text=False).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.remove_bytes(rows, 30)


def test_no_rows(spark):
    empty = brute.frame(spark, ["x"]).limit(0)
    assert remove_repeats(empty).count() == 0 and remove_seen(empty).count() == 0


def test_automaton_knows_all_substrings():
    for seed in range(60):
        r = random.Random(seed)
        added = [[r.randrange(3) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 4))]
        query = [r.randrange(3) for _ in range(20)]
        automaton = SuffixAutomaton()
        for s in added:
            automaton.add(s)
        parts = {tuple(s[i:j]) for s in added for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in parts], default=0) for i in range(20)]
        assert automaton.matching_statistics(query) == want


def test_rounds_find_shared_windows():
    for seed in range(60):
        r = np.random.default_rng(seed)
        columns = r.integers(0, 3, (14, 9)).astype(np.uint16)
        columns[:, r.integers(0, 9, 3)] = columns[:, :1]
        columns[r.integers(0, 14, 4), r.integers(0, 9, 4)] = 256
        group = np.sort(r.integers(0, 3, 9))
        found = {(n, int(i)) for n, rows in insert_columns(columns, group, 4) for i in rows}
        want = set()
        for n in range(3, 14):
            for i in range(9):
                own = columns[n - 3 : n + 1, i]
                same = [j for j in range(9) if j != i and group[j] == group[i] and (columns[n - 3 : n + 1, j] == own).all()]
                if (own != 256).all() and same:
                    want.add((n, i))
        assert found == want


def test_bytes_at_the_registered_length(spark):
    """Passages around 400 bytes: one byte too short, just long enough, overlapping, within one text, and in long texts."""
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefgh ij\n") for _ in range(n))
    just, short, long = noise(400), noise(399), noise(1500)
    rows = [None, "", just, noise(50) + just, short + "X", "Y" + short, noise(300) + long + noise(80), long[700:] + noise(30)]
    rows += [long[:900] + noise(20) + long[600:], "z" * 1201, "é" * 200 + "q", "é" * 200, noise(700) * 2, noise(9000) + just + noise(9000)]
    got = remove_repeats(brute.frame(spark, rows), 400).orderBy("doc_id").collect()
    assert [(g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got] == brute.remove_bytes(rows, 400)
    assert sum(g.n_removed for g in got) > 3000


def test_words_of_very_long_texts(spark):
    r = random.Random(12)
    word = lambda: r.choice(["a", "b", "cd"])
    shared = [word() for _ in range(60)]
    rows = [" ".join([word() for _ in range(30_000)] + shared), "x y", " ".join([*(f"w{i}" for i in range(9000)), *shared, "end"])]
    got = remove_seen(brute.frame(spark, rows), 13).orderBy("doc_id").collect()
    assert [(g.n_words, g.n_removed, g.kept_sha256) for g in got] == brute.remove_words(list(zip(range(1, 4), rows)), 13)
    assert got[2].n_removed == 60
