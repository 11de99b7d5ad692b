"""Feature queries on the company panel."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import METRICS, YEARS
from ..functions.scalars import col, growth
from ..operators import features, groups
from ..sources.panel import company_panel, to_long
from .common import cleaned_panel, feature_frame, r, rounded
from .panel_sql import CLEANED, FEATURES, PANEL, growth_sql

QUERIES: dict = {}
ORACLES: dict = {}

MONEY = {"TAsset", "Leverage", "EBIT", "Turnover", "PLTax"}


def _digits(name: str) -> int:
    return 3 if any(m in name for m in MONEY) and not name.startswith(("growth", "fur")) else 6


def _select(df, names):
    return df.select("row_id", *[r(col(n), _digits(n)).alias(n) for n in names])


def _select_sql(names, source="features"):
    return f"SELECT row_id, {', '.join(f'round({chr(34)}{n}{chr(34)}, {_digits(n)}) + 0.0 AS {chr(34)}{n}{chr(34)}' for n in names)} FROM {source}"


MEANS = [f"{m}_mean" for m in METRICS]
GROWTHS = [f"growth_{m}_mean" for m in METRICS]
VOLS = [f"volatility_{m}" for m in METRICS]
RATIOS = ["fur_debt_to_eq", "fur_op_marg", "fur_asset_turnover", "fur_roa"]

QUERIES["f1_row_means"] = lambda s, d: _select(features.add_means(cleaned_panel(s, d)), MEANS)
ORACLES["f1_row_means"] = FEATURES + _select_sql(MEANS)

PAIRS = list(zip(YEARS, YEARS[1:]))
NUMERIC = [m for m in METRICS if m != "MScore"]
QUERIES["f2_yearly_growth"] = lambda s, d: company_panel(s, d).select(
    "row_id", *[r(growth(col(f"{m}.{c}"), col(f"{m}.{p}"))).alias(f"{m}_{c}") for m in NUMERIC for c, p in PAIRS]
)
ORACLES["f2_yearly_growth"] = (
    PANEL
    + f" SELECT row_id, {', '.join(f'round({growth_sql(m, c, p)}, 6) + 0.0 AS {m}_{c}' for m in NUMERIC for c, p in PAIRS)} FROM panel"
)


def _imputation(s, d):
    frame = cleaned_panel(s, d)
    means = features.growth_means(frame)
    filled = {k: F.coalesce(e, F.lit(means[k])) for k, e in features.growth_columns().items() if means[k] is not None}
    return frame.select("row_id", *[r(e).alias(f"{m}_{c}") for (m, c), e in filled.items()])


QUERIES["f3_imputed_growth"] = _imputation
ORACLES["f3_imputed_growth"] = (
    FEATURES
    + ' SELECT row_id, '
    + ", ".join(
        f'round(coalesce("g_{m}_{c}", avg("g_{m}_{c}") OVER ()), 6) + 0.0 AS {m}_{c}' for m in METRICS for c, _ in PAIRS
    )
    + " FROM grown"
)
QUERIES["f4_mean_growth"] = lambda s, d: _select(features.add_growth(cleaned_panel(s, d)), GROWTHS)
ORACLES["f4_mean_growth"] = FEATURES + _select_sql(GROWTHS)
QUERIES["f5_volatility"] = lambda s, d: _select(features.add_volatility(cleaned_panel(s, d)), VOLS)
ORACLES["f5_volatility"] = FEATURES + _select_sql(VOLS)
for _key, _name in zip(("f6_debt_to_equity", "f7_operating_margin", "f8_asset_turnover", "f9_return_on_assets"), RATIOS):
    QUERIES[_key] = lambda s, d, n=_name: _select(features.add_ratios(features.add_means(cleaned_panel(s, d))), [n])
    ORACLES[_key] = FEATURES + _select_sql([_name])

QUERIES["f10_feature_build"] = lambda s, d: _select(feature_frame(s, d), MEANS + GROWTHS + VOLS + RATIOS)
ORACLES["f10_feature_build"] = FEATURES + _select_sql(MEANS + GROWTHS + VOLS + RATIOS)


def _grouped(pick):
    def run(s, d):
        df = feature_frame(s, d)
        return _select(df, pick(groups.column_sets(df.columns), df.columns))

    return run


def _columns_sql(pattern: str) -> str:
    names = [n for n in MEANS + GROWTHS + VOLS + RATIOS if re.search(pattern, n)]
    return FEATURES + f", picked AS (SELECT row_id, COLUMNS('{pattern}') FROM features) " + _select_sql(names, "picked")


QUERIES["f11_continuous_columns"] = _grouped(lambda g, _: g["continuous"])
ORACLES["f11_continuous_columns"] = _columns_sql("^(growth_)?(TAsset|Leverage|EBIT|Turnover|ROE|PLTax)_mean$|^volatility_[^M]|^fur_")
QUERIES["f12_select_feature_years"] = lambda s, d: rounded(
    groups.project(
        company_panel(s, d), ("row_id", *groups.metric_columns(company_panel(s, d).columns, "EBIT"))
    ).toDF("row_id", *[f"EBIT_{y}" for y in YEARS]),
    [f"EBIT_{y}" for y in YEARS],
    2,
)
ORACLES["f12_select_feature_years"] = (
    PANEL + f""" SELECT row_id, {', '.join(f'round("EBIT.{y}", 2) + 0.0 AS EBIT_{y}' for y in YEARS)} FROM panel"""
)
QUERIES["f13_group_growth"] = _grouped(lambda g, _: g["grow"])
ORACLES["f13_group_growth"] = _columns_sql("^growth_[^M]")
QUERIES["f14_without_volatility"] = _grouped(lambda g, _: groups.without(g["continuous"], g["vol"]))
ORACLES["f14_without_volatility"] = _columns_sql("^(growth_)?(TAsset|Leverage|EBIT|Turnover|ROE|PLTax)_mean$|^fur_")

QUERIES["f0_panel_long_form"] = lambda s, d: rounded(to_long(company_panel(s, d), METRICS), METRICS[1:], 4)
ORACLES["f0_panel_long_form"] = (
    PANEL
    + " UNION ALL ".join(
        f""" SELECT row_id, '{y}' AS year, "MScore.{y}" AS "MScore", {', '.join(f'round("{m}.{y}", 4) + 0.0 AS "{m}"' for m in METRICS[1:])} FROM panel"""
        for y in YEARS
    )
)
