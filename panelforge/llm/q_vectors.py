"""op1: near-dedup of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vectors import near_vectors


def op1_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE u = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.u = v.vec_id
"""

QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLES = {"op1_embedding_dedup": OP1_SQL}
