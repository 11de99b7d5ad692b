"""op13: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .langid import fit_language_model, predict_languages


def op13_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return predict_languages(docs, fit_language_model(docs))


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
