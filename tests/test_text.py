import random
import re

import pytest
from pyspark.sql import functions as F

from prefloom.functions.text import BLANKS, format_prompt, format_response, join_query_response, lstrip, strip
from prefloom.functions.tokens import CallableTokenizer, WordTokenizer
from prefloom.plans.examples import build_sft_examples
from prefloom.schemas import EOS_TEXT, PAD_TEXT, PROMPT_TEMPLATE, SftParams

TOKENIZER = WordTokenizer()
FIELDS = ("subreddit", "title", "post")


def words(text):
    for special in (EOS_TEXT, PAD_TEXT):
        text = text.replace(special, f" {special} ")
    return re.findall(r"\S+", text, re.ASCII)


def fit(fields, budget, cut_text="\n"):
    """The first candidate with few enough words: whole lines go first, then characters of the first line."""
    lines = fields["post"].split(cut_text)
    posts = [cut_text.join(lines[:n]) for n in range(len(lines), 0, -1)]
    posts += [lines[0][:n] for n in reversed(range(len(lines[0])))]
    prompts = (PROMPT_TEMPLATE.format(**{**fields, "post": post}) for post in posts)
    return next((p for p in prompts if len(words(p)) <= budget), None)


def prompts(spark, rows, budget, tokenizer=TOKENIZER):
    df = spark.createDataFrame([(i, *[r[f] for f in FIELDS]) for i, r in enumerate(rows)], ["id", *FIELDS])
    prompt = tokenizer.fit_prompt(PROMPT_TEMPLATE, {f: F.col(f) for f in FIELDS}, budget)
    return [r.prompt for r in df.select("id", prompt.alias("prompt")).orderBy("id").collect()]


def random_post(rng, specials=False):
    pieces = ["a", "word", "b c", " ", "\n", "\n\n", "  x", "longer words here", "\t", "", "\xa0", "no\xa0break", "\x0b", "\x1c"]
    if specials:
        pieces += [EOS_TEXT, PAD_TEXT, "glued" + EOS_TEXT, EOS_TEXT + "tail", "x" + PAD_TEXT + "y"]
    return "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 40)))


@pytest.mark.parametrize("specials", [False, True])
def test_closed_form_cut_equals_the_loop(spark, specials):
    rng = random.Random(7)
    rows = [{"subreddit": "s", "title": "t u", "post": random_post(rng, specials)} for _ in range(600)]
    for budget in (7, 9, 14, 30):
        assert prompts(spark, rows, budget) == [fit(r, budget) for r in rows]


def test_cut_of_one_long_line_keeps_whole_tokens(spark):
    row = {"subreddit": "s", "title": "t", "post": " ".join(f"w{i}" for i in range(20_000))}
    for budget in (50, 9000):
        assert prompts(spark, [row], budget) == [fit_long(row, budget)]


def fit_long(row, budget):
    room = budget - len(words(PROMPT_TEMPLATE.format(**{**row, "post": ""})))
    kept = " ".join(row["post"].split(" ")[:room]) + " "
    return PROMPT_TEMPLATE.format(**{**row, "post": kept})


def test_over_budget_without_a_post_is_null(spark):
    assert prompts(spark, [{"subreddit": "s", "title": "many words in a title", "post": ""}], 5) == [None]


def test_cut_field_must_stand_between_blanks(spark):
    with pytest.raises(ValueError, match="between blanks"):
        TOKENIZER.fit_prompt("r/{post}x", {"post": F.col("post")}, 5)
    with pytest.raises(ValueError, match="blank character"):
        TOKENIZER.fit_prompt("a {post} b", {"post": F.col("post")}, 5, cut_text="--")
    with pytest.raises(ValueError, match="exactly once"):
        TOKENIZER.fit_prompt("a {post} {post}", {"post": F.col("post")}, 5)


def characters():
    # Made in a function, so that it reaches the tasks by value.
    return CallableTokenizer(lambda: lambda text: [ord(c) + 2 for c in text], pad_id=0, eos_id=1)


def test_callable_tokenizer_tries_candidates_in_order(spark):
    tokenizer = characters()
    base = len(PROMPT_TEMPLATE.format(subreddit="s", title="t", post=""))
    rows = [
        {"subreddit": "s", "title": "t", "post": "first line\nsecond"},
        {"subreddit": "s", "title": "t", "post": "only one line"},
        {"subreddit": "s", "title": "a far too long title", "post": "x"},
    ]
    got = prompts(spark, rows, base + 10, tokenizer)
    assert got[0].endswith("POST: first line\n\nTL;DR:")
    assert got[1].endswith("POST: only one l\n\nTL;DR:")
    assert got[2] is None


def test_plans_take_a_callable_tokenizer(spark):
    tokenizer = characters()
    df = spark.createDataFrame([("1", "s", "t", "p", "sum")], ["id", "subreddit", "title", "post", "summary"])
    row = build_sft_examples(df, SftParams(budget=60, total_width=120, response_width=30), tokenizer).first()
    assert row.query_tokens[0] == 0 and len(row.query_tokens) == 60
    assert row.response_token_length == len(" sum" + EOS_TEXT)
    assert [t for t in row.query_and_response_tokens if t] == [ord(c) + 2 for c in row.query.strip() + " sum" + EOS_TEXT]


# Prompt cases: width, short and long posts, both padding sides, a bad side.
EXAMPLE = {"subreddit": "gardening", "title": "Two roses", "post": "Our garden note opens with seven short words.\n\nThen rain came."}


def example(spark, **params):
    df = spark.createDataFrame([("1", *EXAMPLE.values(), "short")], ["id", *FIELDS, "summary"])
    return build_sft_examples(df, SftParams(**{"budget": 50, **params})).first()


def test_prompt_has_the_budget_width(spark):
    row = example(spark)
    assert len(row.query_tokens) == 50 and all(isinstance(t, int) for t in row.query_tokens)


def test_short_prompt_keeps_its_tokens(spark):
    row = example(spark, pad_side="right")
    n = row.query_token_length_without_padding
    assert n == len(words(PROMPT_TEMPLATE.format(**EXAMPLE))) and 0 not in row.query_tokens[:n]


def test_long_prompt_is_cut_at_a_line(spark):
    row = example(spark, budget=17)
    assert "Then rain came" not in row.query and "seven short words." in row.query
    assert len(row.query_tokens) == 17


@pytest.mark.parametrize("side", ["left", "right"])
def test_padding_side(spark, side):
    row = example(spark, pad_side=side)
    n = row.query_token_length_without_padding
    pads = row.query_tokens[:-n] if side == "left" else row.query_tokens[n:]
    assert pads == [0] * (50 - n)


def test_invalid_padding_side(spark):
    with pytest.raises(ValueError, match="Invalid padding side: invalid"):
        example(spark, pad_side="invalid")


def test_blanks_are_those_of_python():
    assert sorted(BLANKS) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())


def test_strip_and_responses(spark):
    texts = ["  a b ", " x ", "\x1cy\x1f", "", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ["id", "t"])
    t = F.col("t")
    rows = df.select(
        "id", strip(t).alias("s"), lstrip(t).alias("l"), join_query_response(t, F.lit(" r")).alias("j"),
        format_response(t, leading_blank=True).alias("r"),
    ).orderBy("id").collect()
    for text, row in zip(texts, rows):
        assert (row.s, row.l, row.j, row.r) == (text.strip(), text.lstrip(), text.strip() + " r", f" {text}{EOS_TEXT}")


def test_null_fields_read_as_none_unless_told(spark):
    df = spark.createDataFrame([(None, "p")], "title string, post string")
    fields = {"title": F.col("title"), "post": F.col("post")}
    row = df.select(
        format_prompt("{title}: {post}", fields).alias("a"), format_prompt("{title}: {post}", fields, "").alias("b")
    ).first()
    assert (row.a, row.b) == ("None: p", ": p")
    with pytest.raises(KeyError):
        format_prompt("{missing}", fields)
    with pytest.raises(ValueError):
        format_prompt("{title:>10}", fields)


def test_word_ids_and_special_texts(spark):
    df = spark.createDataFrame([(f"one two{EOS_TEXT}{PAD_TEXT}one",)], ["t"])
    row = df.select(TOKENIZER.encode(F.col("t")).alias("ids"), TOKENIZER.count(F.col("t")).alias("n"), TOKENIZER.encode(F.col("t"), 2).alias("two")).first()
    assert row.ids[2:4] == [1, 0] and row.ids[0] == row.ids[4] and row.n == 5
    assert row.two == row.ids[:2] and all(i >= 2 for i in row.two)


def test_prompts_that_cannot_fit_are_cut_without_encoding():
    from prefloom.functions.tokens import longest_that_may_fit

    rng = random.Random(3)
    for _ in range(400):
        field = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 12)))
        room = rng.randint(-2, 13)
        slow = field
        while len(slow) > max(room, 0):
            lines, found, _ = slow.rpartition("\n")
            slow = lines if found else slow[:-1]
        assert longest_that_may_fit(field, "\n", room) == slow
