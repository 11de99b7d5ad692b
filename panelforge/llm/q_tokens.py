"""op4: token counts of every text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import count_tokens


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
