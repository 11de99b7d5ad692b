"""op12: 16 clusters of all embeddings by three rounds of Lloyd."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lloyd import centroid_clusters


def op12_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return centroid_clusters(table(spark, d, "embeddings"))


_ROUND = r"""
a{i} AS MATERIALIZED (
  SELECT r, c, s FROM (
    SELECT r, c, s, row_number() OVER (PARTITION BY r ORDER BY s, c) AS place
    FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS s FROM v JOIN c{i} USING (d) GROUP BY r, c)
  ) WHERE place = 1
), c{j} AS MATERIALIZED (
  SELECT c, d, coalesce(f, m) AS m FROM c{i} LEFT JOIN (
    SELECT c, d, (t - ((t % n) + n) % n) // n AS f FROM (SELECT c, d, sum(x)::BIGINT AS t, count(*)::BIGINT AS n FROM a{i} JOIN v USING (r) GROUP BY c, d)
  ) USING (c, d)
),"""

OP12_SQL = (
    r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM kept),
start AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16
), c0 AS MATERIALIZED (SELECT c, unnest(q) AS m, generate_subscripts(q, 1) AS d FROM start),"""
    + "".join(_ROUND.format(i=i, j=i + 1) for i in range(3))
    + r"""
a3 AS MATERIALIZED (
  SELECT r, c, s FROM (
    SELECT r, c, s, row_number() OVER (PARTITION BY r ORDER BY s, c) AS place
    FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS s FROM v JOIN c3 USING (d) GROUP BY r, c)
  ) WHERE place = 1
), digest AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a3 USING (r) JOIN digest USING (c)
"""
)

QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": OP12_SQL}
