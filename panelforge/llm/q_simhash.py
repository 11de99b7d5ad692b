"""op7: SimHash near-dedup of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import fingerprint_hex, near_groups


def op7_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    groups = near_groups(table(spark, d, "documents"))
    return groups.select("doc_id", fingerprint_hex(groups["fp"]).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_dedup": op7_simhash_dedup}
ORACLES: dict[str, str] = {}
