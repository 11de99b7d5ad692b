"""op2: mix all documents to source weights 5, 2, 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import mix_sources


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight): good documents come twice as eagerly as unlabelled ones, poor ones half as eagerly.

    Of several labels of a document the largest counts.
    """
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    return known.select("id", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight"))


def op2_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), quality=quality_weights(table(spark, d, "labels")))


OP2_SQL = r"""
WITH lab AS (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY doc_id),
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM documents LEFT JOIN lab ON doc_id = id
), src AS (
  SELECT source, sum(size)::DOUBLE AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM sized GROUP BY source
), w AS (SELECT *, CASE r WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * s AS cap FROM src),
fill AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w
), lev AS (SELECT arg_min((budget - caps) / ws, cap / w) FILTER ((budget - caps) / ws * w < cap) AS level FROM fill),
tgt AS (SELECT source, s, least(cap, level * w) AS target, floor(least(cap, level * w) / nullif(s, 0)) AS epochs FROM w, lev),
keyed AS (
  SELECT d.doc_id, d.size, t.s, t.target, coalesce(t.epochs, 0) AS epochs, d.source,
         -ln((('0x' || substr(md5('mix|' || d.doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / d.weight AS key
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source
), run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
       (copies * size)::BIGINT AS taken, copies
FROM (SELECT *, (epochs + CASE WHEN upto - size / 2 <= target - epochs * s THEN 1 ELSE 0 END)::BIGINT AS copies FROM run)
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {"op2_mix_sources": OP2_SQL}
