import pytest

from compare import connect, differences
from prefloom.llm.queries import QUERIES, TWINS

FOLDER = "/root/testdata/sf0.001"
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_agrees_with_its_twin(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], TWINS[name]) is None


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_url_filters", "op5_warc_revisits"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in (*BANNED, "Python", "Arrow", "Pandas") if b in plan]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
