"""Multi-year features of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METRICS, YEARS
from ..functions.scalars import col, growth, guarded_ratio, normalize_missing, row_mean, row_std


def year_columns(df: DataFrame, metric: str, years: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [f"{metric}.{y}" for y in years if f"{metric}.{y}" in present]


def _doubles(df: DataFrame, metric: str, years: Sequence[str]) -> list[Column]:
    return [col(c).cast("double") for c in year_columns(df, metric, years)]


def add_means(df: DataFrame, metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS, clean: bool = False) -> DataFrame:
    df = df if clean else normalize_missing(df)
    return df.withColumns({f"{m}_mean": row_mean(_doubles(df, m, years), clean=True) for m in metrics})


def growth_columns(metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS, clean: bool = False) -> dict[tuple[str, str], Column]:
    """Growth into each year but the earliest; years run from latest to earliest.

    ``clean`` says that the frame holds no NaN.
    """
    return {
        (m, current): growth(col(f"{m}.{current}").cast("double"), col(f"{m}.{previous}").cast("double"), clean)
        for current, previous in zip(years, years[1:])
        for m in metrics
    }


def growth_means(df: DataFrame, metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS, clean: bool = False) -> dict[tuple[str, str], float | None]:
    """Mean of every growth column over the whole frame: one aggregate, one row back."""
    df = df if clean else normalize_missing(df)
    exprs = growth_columns(metrics, years, clean=True)
    row = df.agg(*[F.avg(e).alias(f"g{i}") for i, e in enumerate(exprs.values())]).first()
    return {k: row[f"g{i}"] for i, k in enumerate(exprs)}


def add_growth(df: DataFrame, metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS, clean: bool = False) -> DataFrame:
    """Mean growth per metric, missing growth filled with its column mean first."""
    df = df if clean else normalize_missing(df)
    means = growth_means(df, metrics, years, clean=True)
    grown = growth_columns(metrics, years, clean=True)
    filled = {k: e if means[k] is None else F.coalesce(e, F.lit(means[k])) for k, e in grown.items()}
    return df.withColumns(
        {f"growth_{m}_mean": row_mean([e for (metric, _), e in filled.items() if metric == m], clean=True) for m in metrics}
    )


def add_volatility(df: DataFrame, metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS, clean: bool = False) -> DataFrame:
    df = df if clean else normalize_missing(df)
    values = {m: _doubles(df, m, years) for m in metrics}
    centred = df.withColumns({f"_centre_{m}": row_mean(v, clean=True) for m, v in values.items()})
    spread = centred.withColumns({f"volatility_{m}": row_std(v, col(f"_centre_{m}"), clean=True) for m, v in values.items()})
    return spread.drop(*[f"_centre_{m}" for m in metrics])


def add_ratios(df: DataFrame) -> DataFrame:
    assets, leverage = col("TAsset_mean"), col("Leverage_mean")
    ebit, turnover = col("EBIT_mean"), col("Turnover_mean")
    return df.withColumns(
        {
            "fur_debt_to_eq": guarded_ratio(assets, assets - leverage),
            "fur_op_marg": guarded_ratio(ebit, turnover),
            "fur_asset_turnover": guarded_ratio(turnover, assets),
            "fur_roa": guarded_ratio(ebit, assets),
        }
    )


def build_features(df: DataFrame, metrics: Sequence[str] = METRICS, years: Sequence[str] = YEARS) -> DataFrame:
    """Means, growth, volatility, then ratios; NaN in the input becomes NULL, once for all of them."""
    means = add_means(normalize_missing(df), metrics, years, clean=True)
    grown = add_growth(means, metrics, years, clean=True)
    return add_ratios(add_volatility(grown, metrics, years, clean=True))
