"""Scores of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators.rank import best
from ..operators.score import diff_scores


def score_stream(docs: DataFrame, config: Config = DEFAULT, **options) -> DataFrame:
    """The best licence of each document of a stream. Scores and ranking are made inside a row, so no state is kept."""
    return best(diff_scores(docs, config, **options).filter(F.col("scores").isNotNull()))
