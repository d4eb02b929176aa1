"""Operators and stages that return the columns of their input, on a table with all their helpers' names as extra columns."""

import pytest

import corpus_pipeline
from prefloom.llm.quality_rules import FENCES, judge, sketches, with_metrics
from prefloom.llm.secret_scans import redact, scan
from prefloom.llm.substring_dedup import remove_seen
from prefloom.llm.url_filters import filter_urls

HELPERS = (
    "_row _first row first _url _key _id _spans spans key id url _lang _source found _found parts _parts _n _words _lines _hashes _ordered "
    "words lines hashes ordered stutter _stutter line_count _line_count best by_pattern tokens token _low _host _path block payload part body "
    "kept n_words symbol_ratio items base_failed fence_long_words __row __key value features label vector probability is_secret one two region elements"
).split()
FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away from here to there again and again today",
    None,
    "",
    "the quick brown fox jumps over the lazy dog and runs away from here to there again and again today",
    'password = "hunter2-Zx9" and api_key: "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" stand here',
    " ".join(f"word{i}" for i in range(30_000)),
]


def _table(spark, **more):
    rows = [(i, t, "en", "s", len(t or ""), *more.values(), *(f"{h}{i}" for h in HELPERS)) for i, t in enumerate(TEXTS)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{m}` string" for m in more)]
    return spark.createDataFrame(rows, ", ".join([*names, *(f"`{h}` string" for h in HELPERS)]))


def _untouched(df, but=()):
    rows = df.collect()
    for r in rows:
        assert all(r[h] == f"{h}{r['doc_id']}" for h in HELPERS if h not in but)
    return rows


def test_urls(spark):
    rows = _untouched(filter_urls(_table(spark, address="http://a.example.net/x"), url_column="address"))
    assert len(rows) == len(TEXTS) and {r["host"] for r in rows} == {"a.example.net"} and {r["rule"] for r in rows} == {"net/"}


def test_quality_rules(spark):
    metrics = with_metrics(_table(spark))
    rows = _untouched(judge(metrics, sketches(metrics)), ("kept", "n_words", "symbol_ratio", "base_failed"))
    assert len(rows) == len(TEXTS) and not set(FENCES) - set(rows[0].asDict())


def test_redaction(spark):
    docs = _table(spark)
    rows = _untouched(redact(docs, scan(docs)))
    assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, stage):
    docs = _table(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, FOLDER)
    assert out.columns == docs.columns
    rows = _untouched(out)
    if stage == 1:
        assert sorted(r["doc_id"] for r in rows) == [0, 1, 2, 4, 5]


def test_ids_that_have_no_order_of_numbers(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        remove_seen(docs)
