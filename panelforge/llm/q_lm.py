"""op5: language-model score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lm import score_texts


def op5_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_texts(table(spark, d, "documents"))


QUERIES = {"op5_lm_scores": op5_lm_scores}
ORACLES: dict[str, str] = {}
