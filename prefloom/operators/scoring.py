"""User functions over rows and batches, and the scores they bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """A row function over every row, in Arrow batches; ``schema`` declares what it returns. Values reach the
    function as they are: whole numbers stay whole beside NULLs, and NULL is None."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(row) for row in batch.to_pylist()], arrow)

    return df.mapInArrow(run, schema)


def score_batches(
    df: DataFrame, tokens: str, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], out: str = "score"
) -> DataFrame:
    """A score per token array. ``make_scorer()`` loads the model once per task; the scorer then
    gets one Arrow batch of arrays at a time. Only the token column leaves the JVM."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for batch in batches:
            yield scorer(batch)

    return df.withColumn(out, run(F.col(tokens)))


def generate_batches(
    df: DataFrame,
    key: str,
    prompt: str,
    make_generator: Callable[[], Callable[[list[list[int]]], list[list[tuple[list[int], list[float]]]]]],
    batch_size: int = 64,
) -> DataFrame:
    """Responses with their log-probabilities, any number per prompt, from a generator the caller brings:
    ``generate(prompts)`` gets up to ``batch_size`` token lists and returns, for each, its list of
    (tokens, log_probs). A NULL prompt is handed over as None."""
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("response_no", T.IntegerType(), False),
            T.StructField("response_tokens", T.ArrayType(T.LongType())),
            T.StructField("log_probs", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make_generator()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                keys, prompts = (c.to_pylist() for c in whole.slice(at, batch_size).columns)
                rows = [
                    dict(zip(schema.names, (row_key, number, list(tokens), list(log_probs))))
                    for row_key, responses in zip(keys, generate(prompts), strict=True)
                    for number, (tokens, log_probs) in enumerate(responses)
                ]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select(key, prompt).mapInArrow(run, schema)


def attach_scores(df: DataFrame, scores: DataFrame, key: str, *columns: str) -> DataFrame:
    """Add scores computed elsewhere (``score`` unless named); a row without one gets NULL.
    Keys are unique on both sides."""
    return df.join(scores.select(key, *(columns or ("score",))), key, "left")


def unscored(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows no score was found for."""
    return df.join(scores.select(key), key, "left_anti")


def centre_scores(df: DataFrame, score: str = "score", out: str = "centred_score") -> DataFrame:
    """Each score minus the mean of all, which enters the plan as a scalar subquery."""
    mean = df.agg(F.avg(score)).scalar()
    return df.withColumn(out, F.col(score) - mean)
