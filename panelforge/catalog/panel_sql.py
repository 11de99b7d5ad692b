"""The company panel, its cleaned form and its features as DuckDB CTEs."""

from __future__ import annotations

from ..config import COUNTRY_CODES, METRICS, RATING_CODES, YEARS
from ..sources.panel import COUNTRIES, RATING_FLOORS, YEAR_SHIFT


def _case(expr: str, codes: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(CASE {expr} {whens} END AS INTEGER)"


def _panel() -> str:
    sums = []
    for y in YEARS:
        here = f"year(o_orderdate) = {int(y) - YEAR_SHIFT}"
        for name, source, digits in (
            ("turnover", "o_totalprice", 2),
            ("assets", "assets", 2),
            ("leverage", "leverage", 4),
            ("tax", "tax", 4),
        ):
            sums.append(f"round(sum(CASE WHEN {here} THEN {source} END), {digits}) AS {name}_{y}")
    ratings = " ".join(f"WHEN m >= {floor} THEN '{name}'" for name, floor in RATING_FLOORS)
    metrics = []
    for y in YEARS:
        ebit = f"(turnover_{y} - assets_{y})"
        margin = f"({ebit} / nullif(turnover_{y}, 0))"
        rating = ratings.replace("m >=", f"{margin} >=")
        metrics += [
            f"""CASE WHEN {margin} IS NULL THEN NULL {rating} ELSE 'D' END AS "MScore.{y}" """,
            f'assets_{y} AS "TAsset.{y}"',
            f'leverage_{y} AS "Leverage.{y}"',
            f'{ebit} AS "EBIT.{y}"',
            f'turnover_{y} AS "Turnover.{y}"',
            f'{ebit} / nullif(assets_{y} - leverage_{y}, 0) AS "ROE.{y}"',
            f'{ebit} - tax_{y} AS "PLTax.{y}"',
        ]
    countries = ", ".join(f"'{c}'" for c in COUNTRIES)
    first, last = int(min(YEARS)) - YEAR_SHIFT, int(max(YEARS)) - YEAR_SHIFT
    return f"""
lines AS (
  SELECT l_orderkey, sum(l_extendedprice) AS assets, sum(l_extendedprice * l_discount) AS leverage,
         sum(l_extendedprice * l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey),
yearly AS (
  SELECT o_custkey, {', '.join(sums)}
  FROM orders JOIN lines ON o_orderkey = l_orderkey
  WHERE o_orderdate >= TIMESTAMP '{first}-01-01' AND o_orderdate < TIMESTAMP '{last + 1}-01-01'
  GROUP BY o_custkey),
panel AS (
  SELECT c_custkey AS row_id, c_custkey AS "No", c_name AS "Company name", r_name AS "Region",
         ([{countries}])[n_nationkey % {len(COUNTRIES)} + 1] AS "Country",
         CAST(c_nationkey AS VARCHAR) AS "NACE code", c_mktsegment AS "Sector 1", r_name AS "Sector 2",
         {', '.join(metrics)}
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN yearly ON c_custkey = o_custkey)"""


def _cleaned() -> str:
    complete = " AND ".join(f'"{m}.{y}" IS NOT NULL' for y in YEARS for m in METRICS)
    replaced = ", ".join(
        [f'{_case(chr(34) + "Country" + chr(34), COUNTRY_CODES)} AS "Country"']
        + [f'{_case(f"{chr(34)}MScore.{y}{chr(34)}", RATING_CODES)} AS "MScore.{y}"' for y in YEARS]
    )
    return f"""
cleaned AS (
  SELECT * EXCLUDE ("No") REPLACE ({replaced}),
         dense_rank() OVER (ORDER BY "Sector 2" || '_' || "Sector 1") - 1 AS "Combined_Sector"
  FROM panel WHERE {complete})"""


def mean_sql(metric: str) -> str:
    total = " + ".join(f'CAST("{metric}.{y}" AS DOUBLE)' for y in YEARS)
    return f"(({total}) / {len(YEARS)})"


def std_sql(metric: str) -> str:
    mean = mean_sql(metric)
    total = " + ".join(f'pow("{metric}.{y}" - {mean}, 2)' for y in YEARS)
    return f"sqrt(({total}) / {len(YEARS) - 1})"


def growth_sql(metric: str, current: str, previous: str) -> str:
    c, p = f'CAST("{metric}.{current}" AS DOUBLE)', f'CAST("{metric}.{previous}" AS DOUBLE)'
    return f"(CASE WHEN {p} = 0 THEN NULL ELSE ({c} - {p}) / {p} END)"


def _features() -> str:
    pairs = list(zip(YEARS, YEARS[1:]))
    grown = [f'{growth_sql(m, c, p)} AS "g_{m}_{c}"' for m in METRICS for c, p in pairs]
    means = [f'{mean_sql(m)} AS "{m}_mean"' for m in METRICS]
    vols = [f'{std_sql(m)} AS "volatility_{m}"' for m in METRICS]
    growth_means = []
    for m in METRICS:
        total = " + ".join(f'coalesce("g_{m}_{c}", avg("g_{m}_{c}") OVER ())' for c, _ in pairs)
        growth_means.append(f'({total}) / {len(pairs)} AS "growth_{m}_mean"')
    temp = ", ".join(f'"g_{m}_{c}"' for m in METRICS for c, _ in pairs)
    return f"""
grown AS (SELECT *, {', '.join(grown + means + vols)} FROM cleaned),
features AS (
  SELECT * EXCLUDE ({temp}), {', '.join(growth_means)},
         "TAsset_mean" / ("TAsset_mean" - "Leverage_mean" + CAST(1e-6 AS DOUBLE)) AS fur_debt_to_eq,
         "EBIT_mean" / ("Turnover_mean" + CAST(1e-6 AS DOUBLE)) AS fur_op_marg,
         "Turnover_mean" / ("TAsset_mean" + CAST(1e-6 AS DOUBLE)) AS fur_asset_turnover,
         "EBIT_mean" / ("TAsset_mean" + CAST(1e-6 AS DOUBLE)) AS fur_roa
  FROM grown)"""


PANEL = "WITH " + _panel()
CLEANED = PANEL + "," + _cleaned()
FEATURES = CLEANED + "," + _features()
