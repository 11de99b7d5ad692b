"""op6: licence scan of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences as lic
from .common import table


def op6_licence_scan(spark: SparkSession, d: str) -> DataFrame:
    scan = lic.scan_licences(table(spark, d, "documents"))
    return scan.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.array_join(F.transform("sentences", lambda m: m["sentence"]), ",").alias("sentence_ids"),
        F.array_join(F.transform("sentences", lambda m: m["unit"].cast("string")), ",").alias("units"),
        F.size("sentences").cast("long").alias("n_sentences"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in lic.SENTENCES)
    steps, last = [], "seq0"
    for k, (name, ids) in enumerate(lic.RULES):
        pattern = "|" + "|".join(ids) + "|"
        steps.append(
            f"seq{k + 1} AS (SELECT doc_id, CASE WHEN contains(l, '{pattern}') THEN replace(l, '{pattern}', '|') ELSE l END AS l, "
            f"CASE WHEN contains(l, '{pattern}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})"
        )
        last = f"seq{k + 1}"
    return rf"""
WITH known(s, sid) AS (VALUES {known}),
units AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{lic.CUT}'),
           lambda u: trim(regexp_replace(lower(u), '{lic.MARKS}', ' ', 'g'))), lambda u: u <> '') AS us
  FROM documents
), starts AS (
  SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM units
), begun AS (
  SELECT doc_id, us, i FROM starts WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(s || ' ', us[i] || ' '))
), windows AS (
  SELECT doc_id, i, w, array_to_string(us[i:i + w - 1], ' ') AS t
  FROM begun, range(1, {lic.most_units(lic.SENTENCES)} + 1) r(w) WHERE i + w - 1 <= len(us)
), found AS (
  SELECT doc_id, i, arg_max(sid, w) AS sid FROM windows JOIN known ON t = s GROUP BY doc_id, i
), lists AS (
  SELECT doc_id, list(sid ORDER BY i) AS sids, list(i ORDER BY i) AS at FROM found GROUP BY doc_id
), seq0 AS (
  SELECT doc_id, replace(array_to_string(list_transform(sids, lambda x: '|' || x || '|'), ''), '||', '|') AS l, []::VARCHAR[] AS names FROM lists
), {", ".join(steps)}
SELECT d.doc_id, coalesce(array_to_string(s.names, ','), '') AS licences, coalesce(array_to_string(l.sids, ','), '') AS sentence_ids,
       coalesce(array_to_string(l.at, ','), '') AS units, coalesce(len(l.sids), 0)::BIGINT AS n_sentences
FROM documents d LEFT JOIN {last} s ON d.doc_id = s.doc_id LEFT JOIN lists l ON d.doc_id = l.doc_id
"""


QUERIES = {"op6_licence_scan": op6_licence_scan}
ORACLES = {"op6_licence_scan": _sql()}
