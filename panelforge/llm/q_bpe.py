"""op8: encode and decode every text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .common import table


def token_digests(docs: DataFrame) -> DataFrame:
    digest = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return encode_texts(docs).select("doc_id", "n_tokens", *digest)


def op8_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return token_digests(table(spark, d, "documents"))


QUERIES = {"op8_bpe_round_trip": op8_bpe_round_trip}
ORACLES: dict[str, str] = {}
