import time

import pytest
from pyspark.sql import functions as F

import brute
from prefloom.llm.secret_scans import FEATURES, candidates, dictionary_coverage, features, find_candidates, judge, redact, scan, text_key, weak_label
from prefloom.llm.url_filters import HOST_RULES, PATTERN_RULES, UrlRule, filter_urls, rule_index
from prefloom.llm.warc_revisits import resolve_revisits

URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
    "http://myexample.net/en/": ("myexample.net", "/en/", "net/", "block"),
    "http://x.net": ("x.net", "", None, "allow"),
    "http://x.example.com/de/#a://b": ("x.example.com", "/de/", "example.com/de/", "block"),
    "http://x.com/login?next": ("x.com", "/login", None, "block"),
    "http://w.org/fr/login": ("w.org", "/fr/login", "org/fr/", "allow"),
    "http://x.com/a?PHPSESSID=0123456789abcdef": ("x.com", "/a", None, "block"),
    "http://x.com?sid=1": ("x.com", "", None, "allow"),
}


def test_url_verdicts(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate([*URLS, *URLS])]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, token string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [*URLS.values()] * 2
    assert {r.token for r in got} == {"p"}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_indexed_by_their_rarest_literal(spark):
    urls = spark.createDataFrame([(["", "net", "example", "en"],), (["", "net"],)], "tokens array<string>")
    rules = (*HOST_RULES, *PATTERN_RULES, UrlRule("all", "block", pattern="x"))
    index = {r.rule: r.token for r in rule_index(urls, rules).collect()}
    assert index["net/"] == "net" and index["example.net/en/"] == "en" and index["all"] == "" and len(index) == len(rules)


CAPTURES = (
    "record_id string, url string, captured_at long, kind string, etag string, last_modified string, digest string, "
    "headers map<string,string>, full string, slice int"
)


def capture(name, at, kind="response", etag=None, date=None, url="http://www.a.b/x/", headers=None):
    return (name, url, at, kind, etag, date, name, headers, "?", 9)


def test_revisits(spark):
    revisit = lambda name, at, **k: capture(name, at, "revisit", **k)[:6] + (None,) + capture(name, at, "revisit", **k)[7:]
    rows = [
        capture("r1", 10, etag="e", date="d", headers={"Content-Type": "t", "Date": "1"}),
        capture("r2", 10, etag="f", date="d"),
        capture("r3", 99, etag="g"),
        revisit("v0", 10, etag="e"),
        revisit("v1", 11, etag="W/f", url="https://a.b/x#z", headers={"date": "2", "Content-Type": "no", "Vary": None}),
        revisit("v2", 50, etag="e"),
        revisit("v3", 50, etag="f", date="other"),
        revisit("v4", 50),
        revisit("v5", 10**9, etag="g"),
        revisit("v6", 5, etag="e", url=None),
        revisit("v7", None, etag="e"),
        revisit("v8", 60, etag="e", url="http://a.b/x?utm_source=1"),
        revisit("v8", 60, etag="e", url="http://a.b/x?utm_source=1"),
    ]
    found = resolve_revisits(spark.createDataFrame(rows, CAPTURES)).orderBy("record_id").collect()
    assert [(r.record_id, r.status, r.response_id) for r in found] == [
        ("v0", "no_response", None),
        ("v1", "resolved", "r2"),
        ("v2", "mismatch", "r2"),
        ("v3", "mismatch", "r2"),
        ("v4", "no_validator", "r2"),
        ("v5", "resolved", "r3"),
        ("v6", "no_response", None),
        ("v7", "no_response", None),
        ("v8", "mismatch", "r2"),
        ("v8", "mismatch", "r2"),
    ]
    assert found[1].headers == {"date": "2"}
    assert resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


@pytest.mark.parametrize("n", [0, 3, 40])
def test_as_of_against_a_loop(spark, n):
    rows = [capture(f"r{i}", i * 37 % 211, url=f"http://a/{i % 3}") for i in range(n)]
    rows += [capture(f"v{i}", i * 53 % 211, "revisit", url=f"http://a/{i % 3}") for i in range(30)]
    got = {r.record_id: r.response_id for r in resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    for r in rows:
        if r[3] == "revisit":
            earlier = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]]
            assert got[r[0]] == max(earlier, default=(None, None))[1]


KEY = "0f3c9a7be1d24865a0b1c2d3e4f5061728394a5b"


def test_candidates_and_coverage():
    text = f"a token = \"{KEY}\" 1234567890123456 short1 {'word' * 7} abcdefghijklmnopq"
    assert [m.group() for m in candidates(text)] == [KEY, "1234567890123456", "word" * 7]
    assert dictionary_coverage("wordsxx", frozenset({"word", "words"})) == 5 / 7


def corpus(spark):
    rows = [None, "", "nothing here"]
    for i in range(60):
        key = "".join(format((i * 7919 + j * 104729) % 16, "x") for j in range(40))
        rows.append(f"some words here token = \"{key}\" and more é words")
        rows.append(f"call {4000000000000000 + i * 7777777} now, or {key} in words")
    return brute.frame(spark, rows + rows[3:5])


def test_forest_separates_held_out_findings(spark):
    docs = corpus(spark)
    found = find_candidates(docs, frozenset({"words"}))
    labelled = found.withColumn("label", weak_label())
    judged = judge(found, labelled.where("doc_id % 3 = 0")).withColumn("label", weak_label())
    held = judged.where("doc_id % 3 != 0 and label is not null")
    right = held.where((F.col("label") == 1) == F.col("is_secret")).count()
    assert held.count() > 60 and right / held.count() > 0.95
    assert all(len(r.features) == len(FEATURES) for r in found.take(5))


def test_redaction_leaves_the_rest(spark):
    docs = corpus(spark)
    clean = {r.doc_id: r.text for r in redact(docs, scan(docs)).collect()}
    for r in docs.collect():
        if r.text and "token" in r.text:
            assert clean[r.doc_id] == r.text[: r.text.index('"') + 1] + "<secret>" + r.text[r.text.rindex('"') :]
        else:
            assert clean[r.doc_id] == r.text
    assert len(clean) == docs.count()


def test_without_labels_nothing_is_a_secret(spark):
    docs = corpus(spark)
    none = docs.select("doc_id").limit(0)
    assert scan(docs, none).where("is_secret or probability is not null").count() == 0
    empty = docs.limit(0)
    assert scan(empty).count() == 0 and redact(empty, scan(empty)).count() == 0
    both = docs.select(text_key("text").alias("k")).distinct().count()
    assert both == docs.select("text").distinct().count()


@pytest.mark.parametrize(
    "text,values",
    [
        ('password = "hunter2-Zx9"', ["hunter2-Zx9"]),
        ("db_passwd: p@ssw0rd-long-enough-123! next", ["p@ssw0rd-long-enough-123!"]),
        ("api_key='abcdefghijklmnopqr'", ["abcdefghijklmnopqr"]),
        ('{"secret": "a \\"b\\" \u00e9 c", "name": "value"}', ['a \\"b\\" \u00e9 c']),
        ("the password is 'x#1', not 'y#2' as somebody else had written", ["x#1", "y#2"]),
        ("Authorization: Bearer a.b-c~d", ["a.b-c~d"]),
        ("pwd=''\npwd=q", ["q"]),
        ('token=a"b and "c d"e', ['a"b', "c d"]),
        (f"password={KEY}! {KEY}", [f"{KEY}!", KEY]),
        ("name = 'hunter2-Zx9', it's what they don't say", []),
    ],
)
def test_whole_values_beside_key_words(text, values):
    assert [m.group() for m in candidates(text)] == values
    assert all(len(features(text, m, "", frozenset())) == len(FEATURES) for m in candidates(text))


def test_candidates_of_long_lines_take_linear_time():
    for part in ("key", "key=\"", "key='a ", "token: ", "password \\", '"key '):
        began = time.monotonic()
        list(candidates(part * 50_000))
        assert time.monotonic() - began < 5


def test_short_and_punctuated_passwords_are_redacted(spark):
    rows = [r.text for r in corpus(spark).collect()]
    secret = [f"p@{i}!" if i % 2 else f"Hunter{i}-Zx9" for i in range(60)]
    docs = brute.frame(spark, rows + [f"some words password = \"{s}\" and more words" for s in secret])
    clean = {r.doc_id: r.text for r in redact(docs, scan(docs)).collect()}
    assert [clean[len(rows) + 1 + i] for i in range(60)] == ['some words password = "<secret>" and more words'] * 60
