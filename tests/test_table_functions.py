import pytest

from prefloom.operators.table_functions import register_generator


@pytest.fixture()
def echo(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)

        def generate(prompts):
            return [[(list(p or []), [-float(len(prompts))])] * (2 if p else 1) for p in prompts]

        return generate

    register_generator(spark, "echo", make, batch_size=3)
    df = spark.createDataFrame([(f"k{i}", None if i == 4 else [i, i + 1], "x") for i in range(8)], "name string, ids array<int>, more string")
    df.coalesce(1).createOrReplaceTempView("prompts")
    return made


def test_sql_calls_the_generator_in_batches(spark, echo):
    rows = spark.sql("SELECT * FROM echo(TABLE(prompts), 'name', 'ids')").collect()
    assert sorted((r.name, r.response_no) for r in rows) == sorted([(f"k{i}", n) for i in range(8) for n in (0, 1) if i != 4] + [("k4", 0)])
    assert {len(r.response_tokens) for r in rows if r.name != "k4"} == {2}
    assert sorted(r.log_probs[0] for r in rows if r.response_no == 0) == [-3.0] * 6 + [-2.0] * 2 and echo.value == 1


def test_partitions_of_the_call(spark, echo):
    rows = spark.sql("SELECT * FROM echo(TABLE(prompts) PARTITION BY (name), 'name', 'ids')").collect()
    assert len(rows) == 15 and {r.log_probs[0] for r in rows} == {-1.0}


def test_wrong_calls_fail_before_they_run(spark, echo):
    for call, message in (("'nobody', 'ids'", "no column"), ("'name', 'more'", "arrays of token ids")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM echo(TABLE(prompts), {call})")
    assert spark.sql("SELECT * FROM echo(TABLE(SELECT * FROM prompts WHERE false), 'name', 'ids')").count() == 0
