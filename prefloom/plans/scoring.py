"""Scoring a data set and centring its scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators.scoring import centre_scores, score_batches
from prefloom.session import cut_lineage
from prefloom.sources.tables import write_with_scores


def score_and_centre(
    df: DataFrame, tokens: str, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], path: str | None = None
) -> DataFrame:
    """The rows with ``score`` and ``centred_score``.

    The scored rows are written once, as the result needs them anyway: to ``<path>_with_rewards``, which must not
    exist, or without ``path`` to the shared folder. The mean reads only the score column of what was written,
    and centring is a projection of it: the model runs once per row, and nothing is joined or shuffled.
    """
    scored = score_batches(df, tokens, make_scorer)
    if path is None:
        return centre_scores(cut_lineage(scored))
    stored = write_with_scores(scored, path, F.col("score"), "score")
    return centre_scores(df.sparkSession.read.schema(scored.schema).parquet(stored))
