"""op9: verdict for the URL of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import urls
from .common import table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op9_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge_urls(table(spark, d, "pages"), RULES)


def _level(i: int, key: str) -> str:
    """The CTEs of one level of the tree; ``cur{i}`` becomes ``cur{i + 1}``."""
    return f"""
child{i} AS (
  SELECT host, template, {key} AS seg, sum(pages) AS pages, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM cur{i} GROUP BY host, template, {key}
), both{i} AS (
  SELECT *, (all_blocked - blocked) / nullif(all_labelled - labelled, 0) AS rest, (blocked + {urls.DIFFERS} / 2.0::DOUBLE) / (labelled + {urls.DIFFERS}) AS centre,
         sqrt({urls.DIFFERS}::DOUBLE) * sqrt(blocked * (labelled - blocked) / nullif(labelled, 0) + {urls.DIFFERS}::DOUBLE / 4) / (labelled + {urls.DIFFERS}) AS half
  FROM (SELECT *, sum(labelled) OVER p AS all_labelled, sum(blocked) OVER p AS all_blocked, bool_or(seg = '*' AND labelled > 0) OVER p AS starred
        FROM child{i} WINDOW p AS (PARTITION BY host, template))
), step{i} AS (
  SELECT host, template, seg,
         CASE WHEN seg = '' THEN template
              WHEN seg IN ('$', '**') THEN template || '/' || seg
              WHEN labelled = 0 THEN template || CASE WHEN starred THEN '/?' ELSE '/*' END
              WHEN rest IS NULL OR rest < centre - half OR rest > centre + half THEN template || '/' || seg
              ELSE template || '/#' END AS nxt
  FROM both{i}
), cur{i + 1} AS (
  SELECT c.* EXCLUDE (template), s.nxt AS template FROM cur{i} c JOIN step{i} s ON c.host = s.host AND c.template = s.template AND c.{key} = s.seg
)"""


def _sql() -> str:
    keys = [f"s{i + 1}" for i in range(urls.DEPTH + 1)]
    fits = ["CASE"]
    verdict = ["CASE"]
    for v, domain, start in sorted(RULES, key=lambda x: -len(x[1] + x[2])):
        test = f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}') THEN"
        fits.append(f"{test} '{domain}{start}'")
        verdict.append(f"{test} '{v}'")
    segs = []
    for i, k in enumerate(keys[:-1]):
        segs.append(
            f"CASE WHEN len(parts) > {i} THEN CASE WHEN length(parts[{i + 1}]) > {urls.LONG_SEGMENT} THEN '*' "
            f"ELSE regexp_replace(parts[{i + 1}], '[0-9]+', '*', 'g') END WHEN len(parts) = {i} THEN '$' ELSE '' END AS {k}"
        )
    segs.append(f"CASE WHEN len(parts) > {urls.DEPTH} THEN '**' WHEN len(parts) = {urls.DEPTH} THEN '$' ELSE '' END AS {keys[-1]}")
    ks = ", ".join(keys)
    levels = ",".join(_level(i, k) for i, k in enumerate(keys))
    last = f"cur{len(keys)}"
    on = " AND ".join(f"r.{k} = t.{k}" for k in keys)
    return rf"""
WITH after AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         string_split(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^/', ''), '/') AS parts
  FROM after
), ruled AS (
  SELECT page_id, host, path, {" ".join(fits)} END AS rule, {" ".join(verdict)} END AS ruled, {", ".join(segs)} FROM parts
), cur0 AS (
  SELECT host, {ks}, count(*)::DOUBLE AS pages, count(ruled)::DOUBLE AS labelled,
         count(*) FILTER (ruled = 'block')::DOUBLE AS blocked, '' AS template
  FROM ruled GROUP BY host, {ks}
), {levels},
overall AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0) AS share FROM cur0),
hosts AS (
  SELECT host, (sum(blocked) + {urls.SMOOTH} * any_value(share)) / (sum(labelled) + {urls.SMOOTH}) AS prior FROM cur0, overall GROUP BY host
), scored AS (
  SELECT c.host, c.template, sum(labelled) > 0 AS judged, (sum(blocked) + {urls.SMOOTH} * any_value(prior)) / (sum(labelled) + {urls.SMOOTH}) AS purity
  FROM {last} c JOIN hosts h ON c.host = h.host GROUP BY c.host, c.template
)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN s.judged AND s.purity >= {urls.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, s.purity
FROM ruled r JOIN {last} t ON r.host = t.host AND {on}
JOIN scored s ON s.host = t.host AND s.template = t.template
"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _sql()}
