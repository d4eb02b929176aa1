"""Generation as a table function that SQL can call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register_generator(
    spark: SparkSession,
    name: str,
    make_generator: Callable[[], Callable[[list[list[int]]], list[list[tuple[list[int], list[float]]]]]],
    batch_size: int = 64,
) -> None:
    """Make a generator (see ``generate_batches``) callable as ``name(TABLE(...), 'key', 'prompt')`` in SQL.

    The table stays as it is dealt out (or as the call's PARTITION BY deals it); each task makes the generator
    once for its rows, or once for each partition of the call. The result's key has the type of the table's, and
    a call that names a column which is not there, or prompts that are no arrays of whole numbers, fails before
    anything runs. Prompts are handed over ``batch_size`` at a time, NULL ones as None.
    """

    class Generate:
        @staticmethod
        def analyze(table: AnalyzeArgument, key: AnalyzeArgument, prompt: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument is a table: TABLE(...)")
            columns = {f.name: f.dataType for f in table.dataType.fields}
            missing = [c.value for c in (key, prompt) if c.value not in columns]
            if missing:
                raise ValueError(f"the table has no column {missing[0]!r}; it has {sorted(columns)}")
            kind = columns[prompt.value]
            if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType)):
                raise ValueError(f"prompts are arrays of token ids, {prompt.value} is {kind.simpleString()}")
            return AnalyzeResult(
                T.StructType(
                    [
                        T.StructField(key.value, columns[key.value]),
                        T.StructField("response_no", T.IntegerType()),
                        T.StructField("response_tokens", T.ArrayType(T.LongType())),
                        T.StructField("log_probs", T.ArrayType(T.DoubleType())),
                    ]
                )
            )

        def __init__(self):
            self.generate = None
            self.held = []

        def _flush(self):
            if self.held:
                keys, prompts = zip(*self.held)
                self.held = []
                for key, responses in zip(keys, self.generate(list(prompts)), strict=True):
                    for number, (tokens, log_probs) in enumerate(responses):
                        yield key, number, list(tokens), list(log_probs)

        def eval(self, row, key: str, prompt: str):
            self.generate = self.generate or make_generator()
            self.held.append((row[key], row[prompt]))
            if len(self.held) >= batch_size:
                yield from self._flush()

        def terminate(self):
            yield from self._flush()

    spark.udtf.register(name, F.udtf(Generate))
