"""op10: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import Chain, fit_chain, score_chain

LANGUAGES = ("de", "en", "es", "fr")


def categories_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic_de.., toxic): the label split by the language of its document, then as it is."""
    lang = docs.select("doc_id", "lang")
    both = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).join(lang, "doc_id")
    per = [((F.col("toxic") == 1) & (F.coalesce("lang", F.lit("")) == x)).cast("int").alias(f"toxic_{x}") for x in LANGUAGES]
    return both.select("doc_id", *per, "toxic")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    return fit_chain(docs, categories_of(docs, labels), [*[f"toxic_{x}" for x in LANGUAGES], "toxic"])


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_chain(docs, toxicity_chain(docs, table(spark, d, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
