import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from prefloom.catalog.subword_queries import BUDGET, EOS_ID, TOKENIZER, TOKENS
from prefloom.functions.subwords import SubwordTokenizer, merge_pairs
from prefloom.functions.text import format_prompt
from prefloom.plans.examples import build_sft_examples
from prefloom.schemas import PROMPT_TEMPLATE, SftParams

ENCODER = TOKENIZER.encoder()


def _loop(head, body, tail, budget, cut_text="\n"):
    """Candidates one after the other, each encoded whole."""
    while True:
        ids = ENCODER.encode(head + body + tail)
        if len(ids) <= budget:
            return head + body + tail, ids
        if not body:
            return None
        lines, found, _ = body.rpartition(cut_text)
        body = lines if found else body[:-1]


def test_merging_by_rank():
    ranks = {t: i for i, t in enumerate(TOKENS)}
    for word, pieces in ((b"the", [b"the"]), (b" tion", [b" t", b"ion"]), (b"ththe", [b"th", b"the"]), (b"", []), (b"x", [b"x"])):
        assert merge_pairs(word, ranks) == [ranks[p] for p in pieces]


def test_search_finds_what_the_loop_finds():
    rng = random.Random(3)
    parts = ["the ", "tion", "and", " ", "\n", "\n\n", "  ", "é", "ü", "<|endoftext|>", "[PAD]", "<|end", "x", "ing ", "漢", "."]
    cut = 0
    for _ in range(1500):
        body = "".join(rng.choices(parts, k=rng.randrange(25)))
        head, tail = rng.choice(["", "a: ", "th", "POST: "]), rng.choice(["", "\n\nT:", "e", "oftext|>", " x"])
        budget = rng.randrange(25)
        expected = _loop(head, body, tail, budget)
        assert ENCODER.fit(head, body, tail, budget, "\n") == expected
        cut += expected is not None and expected[0] != head + body + tail
    assert cut > 300


@pytest.mark.parametrize("body", ["the quick brown fox " * 5000, "x" * 100_000, "a line of text\n" * 7000], ids=["words", "one word", "lines"])
def test_long_texts_are_cut_fast(body):
    ENCODER.encode(body)
    start = time.process_time()
    text, ids = ENCODER.fit("POST: ", body, "\n\nTL;DR:", 512, "\n")
    assert time.process_time() - start < 1 and len(ids) <= 512 and len(text) > 500


def test_special_texts_and_limits(spark):
    df = spark.createDataFrame([(1, "the[PAD]the<|endoftext|>"), (2, None), (3, "")], "id int, text string")
    rows = df.select("id", TOKENIZER.encode(F.col("text")).alias("a"), TOKENIZER.encode(F.col("text"), 2).alias("b"), TOKENIZER.count(F.col("text")).alias("n"))
    the = 256 + 20
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, [the, EOS_ID + 1, the, EOS_ID], [the, EOS_ID + 1], 4), (2, None, None, None), (3, [], [], 0)]


def test_decoding(spark):
    snow = [i for i in "☃".encode()]
    ids = [[256, *snow, EOS_ID, 256], [snow[0], 256], None, [], [None, 999_999, -5, ord("x")]]
    df = spark.createDataFrame(list(enumerate(ids)), "id int, ids array<bigint>")
    texts = [r[0] for r in df.orderBy("id").select(TOKENIZER.decode(F.col("ids"))).collect()]
    assert texts == ["th☃th", "�th", None, "", "x"]


def test_vocabulary_files(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(TOKENS)))
    read = SubwordTokenizer.from_ranks(str(path))
    assert read.tokens == TOKENS and (read.eos_id, read.pad_id) == (len(TOKENS), len(TOKENS) + 1)
    path.write_text(f"{base64.b64encode(b'a').decode()} 1\n")
    with pytest.raises(ValueError, match="gaps"):
        SubwordTokenizer.from_ranks(str(path))
    with pytest.raises(ValueError, match="single bytes"):
        SubwordTokenizer((b"a",), 1, 2)
    with pytest.raises(ValueError, match="ids of their own"):
        SubwordTokenizer(TOKENS, 3, 4)


def test_published_vocabulary_agrees_with_its_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    own = SubwordTokenizer.from_ranks(path, pattern=public.PATTERN).encoder()
    ranks = {t: i for t, i in own.ranks.items()}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    assert all(own.encode(t) == other.encode_ordinary(t) for t in texts)


def test_examples_of_both_kinds_of_response(spark):
    rows = [("a", "s", "t", "the post", "short"), ("b", "s", "t", "line\n" * 300, "and " * 200), ("c", "s" * 300, "t", "x", "y")]
    posts = spark.createDataFrame(rows, "id string, subreddit string, title string, post string, summary string")
    params = SftParams(budget=64, response_width=20, total_width=84)
    got = {r.id: r for r in build_sft_examples(posts, params, TOKENIZER).collect()}
    assert (got["a"].eos_kept, got["b"].eos_kept, got["c"].status) == (True, False, "over_budget")
    prompt = format_prompt(PROMPT_TEMPLATE, {n: F.col(n) for n in ("subreddit", "title", "post")})
    whole = {r.id: r.p for r in posts.select("id", prompt.alias("p")).collect()}
    for i in "ab":
        head, tail = whole[i].split("POST: ")[0] + "POST: ", "\n\nTL;DR:"
        expected = _loop(head, whole[i][len(head) : -len(tail)], tail, 64)
        assert got[i].query == expected[0] and [t for t in got[i].query_tokens if t != TOKENIZER.pad_id] == expected[1]
    assert BUDGET > 0
