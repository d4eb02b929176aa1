"""Very long texts beside short ones, compared with brute force."""

import random

import brute
from prefloom.llm.benchmark_decontamination import decontaminate
from prefloom.llm.best_fit_packing import pack
from prefloom.llm.jaccard_join import jaccard_classes
from prefloom.llm.lm_scoring import score
from prefloom.llm.queries import tokenizer_path


def _long(seed, n=25_000):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_scores(spark):
    words = _long(1)
    got = {r.doc_id: r for r in score(brute.frame(spark, [" ".join(words), " ".join(words), "w1 new"])).collect()}
    assert got[1].n_words == got[1].n_hits == 25_000 and got[1].log_score == got[2].log_score
    assert (got[3].n_words, got[3].n_unseen) == (2, 1)


def test_classes(spark):
    words = _long(2)
    near = [w if i % 200 else "other" for i, w in enumerate(words)]
    far = [w if i % 20 else "other" for i, w in enumerate(words)]
    rows = [" ".join(x) for x in (words, near, far, words[:50])]
    first, sizes = brute.classes(rows)
    got = jaccard_classes(brute.frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(s, f + 1) for s, f in zip(sizes, first)]
    assert first == [0, 0, 2, 3]


def test_contamination(spark):
    words = _long(3)
    items = [(1, " ".join(words[500:540])), (2, " ".join(words[24_990:]))]
    rows = [" ".join(words), " ".join(words[510:520])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(brute.frame(spark, rows), bench, 13).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == [brute.contamination(t, items) for t in rows]


def test_pieces(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    text = " ".join(_long(4))
    ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
    got = pack(brute.frame(spark, [text, None]), tokenizer_path(), keep_ids=True).where("doc_id = 1").orderBy("piece").collect()
    assert [t for r in got for t in r.ids] == ids
    assert [r.length for r in got[:-1]] == [2048] * (len(got) - 1) and [r.start for r in got] == list(range(0, len(ids), 2048))
