import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from prefloom.llm import benchmark_decontamination
from prefloom.llm.benchmark_decontamination import contaminated, decontaminate
from prefloom.llm.best_fit_packing import best_fit_runs, pack, token_bytes
from prefloom.llm.lm_scoring import score
from prefloom.llm.quality_rules import judge, sketches, with_metrics
from prefloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("windows", [3, 500_000])
def test_decontamination_against_brute_force(spark, monkeypatch, windows):
    monkeypatch.setattr(benchmark_decontamination, "WINDOWS", windows)
    r = random.Random(1)
    word = lambda: r.choice(["a", "B", "c1", "ü", "zz"])
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 3, 6, 9)] + [(10, None), (11, "?!"), (12, "a  B"), (12, "A-b")]
    rows = [None, "", "--", "a", *(r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(1, 80))) for _ in range(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(brute.frame(spark, rows), bench, 5).withColumn("bad", contaminated()).orderBy("doc_id").collect()
    for text, row in zip(rows, got):
        n, hit, found = brute.contamination(text, items, 5)
        assert (row.n_words, row.n_hit, list(row["items"]), row.bad) == (n, hit, found, hit > 0 and 20 * hit >= n)
        raw = (text or "").encode()
        assert sum(brute.contamination(raw[s.start : s.end].decode(), [], 5)[0] for s in row.spans) == hit
        assert row.block == "x" and row.size == 1
    assert decontaminate(brute.frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_best_fit_uses_as_few_bins_as_a_plain_loop():
    for seed in range(150):
        r = random.Random(seed)
        size = r.choice([7, 16, 50])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 120))]
        counts = {n: lengths.count(n) for n in lengths}
        runs = best_fit_runs(counts, size)
        bins: dict[int, list[tuple[int, int]]] = {}
        for n, count in counts.items():
            for rank in range(count):
                _, first, start, offset, each = [x for x in runs if x[0] == n and x[1] <= rank][-1]
                number, slot = divmod(rank - first, each)
                bins.setdefault(start + number, []).append((offset + slot * n, n))
        for content in bins.values():
            content.sort()
            assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))]
            assert sum(n for _, n in content) <= size
        assert len(bins) == brute.best_fit(lengths, size)


SPECIAL = [
    "á ́b <|endoftext|>x don't foo \x1cbar\x85z ΑΣ Σ  'S 12ab",
    "<|startoftext|> <|endoftext|>",
    "O'Reilly 'SS 'd a_b__ 1_2",
    *(f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c).upper()}x" for c in range(0x180)),
]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0]
    assert token_bytes(path, SPECIAL) == [np.array(ids(t)[:-1], "<u4").tobytes() for t in SPECIAL]
    rows = [None, "", "one two", "one two", *(f"w{n} " * (n * 7 % 90) for n in range(60)), *SPECIAL[:3]]
    docs = [None if i == 4 else i for i in range(len(rows))]
    got = pack(brute.frame(spark, rows, docs), path, 64, keep_ids=True).collect()
    want = []
    for i, text in zip(docs, rows):
        own = ids(text)
        for piece, start in enumerate(range(0, len(own), 64)):
            body = own[start : start + 64]
            want.append((str(i), piece, start, len(body), zlib.crc32(np.array(body, "<u4").tobytes()), body))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == sorted(want)
    sequences: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in sequences.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= 64
    assert len(sequences) == brute.best_fit([w[3] for w in want], 64)
    assert pack(brute.frame(spark, rows).limit(0), path).count() == 0


def test_scores_of_copies_and_strangers(spark):
    rows = [None, "", "a b c", "A b c", "x y", "a q"]
    got = {r.doc_id: r for r in score(brute.frame(spark, rows), order=2).collect()}
    assert (got[1].n_words, got[1].log_score, got[2].log_score) == (0, 0, 0)
    # Elsewhere a occurs twice among the seven words of the others, b follows one of the two, c follows b.
    log = lambda x: round(np.log(x) * 1_000_000)
    assert got[3].log_score == log(2 / 7) + log(1 / 2) + log(1 / 1) == got[4].log_score
    assert (got[5].n_unseen, got[5].n_hits) == (2, 0)
    assert got[6].log_score == log(2 / 8) + round((np.log(1 / 9) + np.log(0.4)) * 1_000_000)
    three = {r.doc_id: r for r in score(brute.frame(spark, rows), order=3).collect()}
    assert three[3].n_hits == 3 and three[3].log_score == got[3].log_score
    assert score(brute.frame(spark, rows).limit(0)).count() == 0


def test_quality_of_broken_tables(spark):
    good = " ".join(f"word{i % 17}" for i in range(40))
    rows = [None, "", "one two", good + " end", "# " * 60 + good, "same " * 60, "x " * 30000, "\n".join([good] * 4)]
    metrics = with_metrics(brute.frame(spark, rows))
    got = {r.doc_id: r for r in judge(metrics, sketches(metrics)).collect()}
    assert [got[i].base_failed for i in (1, 2, 3)] == [True] * 3 and got[1].n_words == 0
    assert got[8].n_dup_lines == 3 and got[8].n_repeat_words == got[8].n_words == 160
    assert got[7].n_words == 30000 == got[7].n_repeat_words
    assert got[4].kept == (not got[4].base_failed) and got[4].rule == "z"
    empty = with_metrics(brute.frame(spark, rows).limit(0))
    assert judge(empty, sketches(empty)).count() == 0


def test_fences_adapt_to_the_group(spark):
    r = random.Random(5)
    clean = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(60))
    code = lambda: " ".join("".join(r.choice("ab%&") for _ in range(r.randint(3, 7))) for _ in range(60))
    rows = [(i, clean(), "en", "prose") for i in range(150)] + [(1000 + i, code(), "en", "code") for i in range(150)]
    rows += [(5000, code(), "en", "prose"), (5001, code(), "en", "code")]
    metrics = with_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = judge(metrics, sketches(metrics))
    assert [x.doc_id for x in got.where(~F.col("kept")).collect()] == [5000]
