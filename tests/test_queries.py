import pytest

import __spark_entry__ as contract
from compare import connect, differences
from prefloom.catalog.registry import QUERIES, TWINS

FOLDER = "/root/testdata/sf0.001"
# Plans that would pair every row with every row.
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == TWINS.keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 200 and "query_and_response_labels" in df.columns


@pytest.mark.parametrize("name", ["build_sft_examples", "build_sft_examples_subword"])
def test_examples_meet_short_and_long_responses_and_prompts(spark, name):
    """Both kinds of response and of prompt occur in the given texts, so their queries say something."""
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").select("eos_kept", "query_tokens", "response_token_length").collect()
    kept = sum(r.eos_kept for r in rows)
    assert len(rows) == 1000 and 50 < kept < 950 and max(r.response_token_length for r in rows) > 1000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_twin(spark, con, name):
    run = QUERIES[name]
    assert differences(spark, con, FOLDER, run, TWINS[name]) is None
    plan = run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]
