import numpy as np
import pytest

from prefloom.operators import groups as gr
from prefloom.operators.skew import hot_keys, join_unique
from prefloom.plans.rollouts import audit_rollouts


def scores(spark, n=4000):
    rng = np.random.default_rng(5)
    rows = [(i, 0 if i % 3 == 0 else i % 40, float(v)) for i, v in enumerate(rng.normal(size=n))]
    return rows, spark.createDataFrame(rows, "id int, prompt_id int, score double").repartition(6)


def expected(rows, normalize=True):
    out = {}
    for group in {r[1] for r in rows}:
        members = [r for r in rows if r[1] == group]
        values = np.array([r[2] for r in members])
        centred = values - values.mean()
        if normalize:
            centred = centred / (values.std(ddof=1) + 1e-7)
        out |= {r[0]: a for r, a in zip(members, centred)}
    return out


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("min_hot_rows", [50, 10**6])
def test_advantages_agree_with_and_without_hot_groups(spark, normalize, min_hot_rows):
    rows, df = scores(spark)
    got = gr.group_advantage(df, "prompt_id", normalize=normalize, min_hot_rows=min_hot_rows)
    want = expected(rows, normalize)
    result = {r.id: r.advantage for r in got.collect()}
    assert result.keys() == want.keys()
    assert all(result[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert abs(sum(result.values())) < 1e-6


def test_hot_rows_are_not_shuffled(spark):
    _, df = scores(spark)
    assert 0 in hot_keys(df, "prompt_id", min_rows=200)
    plan = gr.group_advantage(df, "prompt_id", min_hot_rows=200)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_a_hot_null_group(spark):
    rows, _ = scores(spark)
    nulled = spark.createDataFrame([(i, g or None, s) for i, g, s in rows], "id int, prompt_id int, score double")
    assert None in hot_keys(nulled, "prompt_id", min_rows=50)
    want = expected(rows)
    got = {r.id: r.advantage for r in gr.group_advantage(nulled, "prompt_id", min_hot_rows=50).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_edge_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "prompt_id int, score double")
    got = {(r.prompt_id, r.advantage) for r in gr.group_advantage(df, "prompt_id").collect()}
    assert got == {(1, 0.0), (2, 0.0)}


def test_group_size_is_enforced(spark, failing):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "prompt_id int, score double")
    assert "group 1 has 1 responses, expected 2" in failing(gr.group_advantage(df, "prompt_id", group_size=2))
    assert "expected 2" in failing(gr.check_group_size(df, "prompt_id", 2))
    large = spark.range(500).selectExpr("0 as prompt_id", "cast(id as double) as score")
    assert "group 0 has 500 responses" in failing(gr.group_advantage(large, "prompt_id", group_size=2, min_hot_rows=100))
    assert gr.check_group_size(df.where("prompt_id = 2"), "prompt_id", 2).first().n == 2


def test_join_unique_equals_a_plain_join(spark):
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else (7 if i % 3 else i % 20)) for i in range(2000)], "id int, k int")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(5, 30)], "k int, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(lookup, "k", how).select("id", "k", "v").collect()), key=str)
        for hot in ([], [7], [7, 3, 99], [None], [7, None]):
            got = join_unique(rows, lookup, "k", hot, ["id"], how).select("id", "k", "v").collect()
            assert sorted(map(tuple, got), key=str) == want
    with pytest.raises(ValueError):
        join_unique(rows, lookup, "k", [], ["id"], "full")


def test_fan_out(spark):
    rows = gr.fan_out(spark.range(3), 2).collect()
    assert sorted(map(tuple, rows)) == [(i, c) for i in range(3) for c in range(2)]


def test_audit_of_rollouts(spark):
    data = [
        (0, [5, 1, 0], [0.0, 3.0, 9.0]),
        (0, [5, 6, 7], [0.0, 0.0, 9.0]),
        (1, [0, 0, 0], [4.0, 4.0, 4.0]),
        (1, [1, 0, 0], [4.0, 9.0, 9.0]),
    ]
    df = spark.createDataFrame(data, "prompt_id int, response_tokens array<bigint>, token_scores array<double>")
    rows = audit_rollouts(df, pad_id=0, eos_id=1, group_size=2, normalize=False).collect()
    got = sorted((r.prompt_id, r.score, r.empty_response, r.advantages) for r in rows)
    assert got == [
        (0, -1.0, False, [-2.0, -2.0, -2.0]),
        (0, 3.0, False, [2.0, 2.0, 0.0]),
        (1, 0.0, True, [0.0, 0.0, 0.0]),
        (1, 4.0, False, [2.0, 0.0, 0.0]),
    ]
