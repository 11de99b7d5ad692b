"""From raw documents to encoded training data, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is stored and read again
as the documents of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.bpe import encode_texts
from panelforge.llm.common import table
from panelforge.llm.exact import drop_exact_copies
from panelforge.llm.mixing import mixed_documents
from panelforge.llm.q_mixing import quality_weights
from panelforge.llm.q_toxicity import toxicity_chain
from panelforge.llm.simhash import drop_near_copies
from panelforge.llm.toxicity import drop_toxic
from panelforge.session import store


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints stays: 3-word shingles, at most 3 bits."""
    return drop_near_copies(docs, words=3, distance=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of sources asks for."""
    return mixed_documents(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the tokens, and a hash of the text they decode to."""
    return encode_texts(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Classifier, fingerprints and encoding have no SQL form; the run is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
