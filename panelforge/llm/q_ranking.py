"""op11: documents ranked for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ranking import rank_documents


def op11_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return rank_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), full_doc AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM doc WHERE len(terms) > 0),
tot AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM full_doc),
wanted AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
tf AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM full_doc)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * any_value(n_docs) + 2.0) / (2.0::DOUBLE * count(*) + 1.0)))::BIGINT AS w
  FROM tf, tot GROUP BY term
), score AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term), tot GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": OP11_SQL}
