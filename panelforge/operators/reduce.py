"""Variance selection and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, complete_rows, number
from .gram import pair_moments


def variances(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Population variance per column, one aggregate."""
    row = df.agg(*[F.var_pop(number(col(c))).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def select_by_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.1) -> list[str]:
    """Columns whose population variance exceeds the threshold."""
    found = variances(df, cols)
    return [c for c in cols if found[c] is not None and found[c] > threshold]


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.1) -> DataFrame:
    return df.select(*[col(c) for c in select_by_variance(df, cols, threshold)])


@dataclass(frozen=True)
class Components:
    cols: tuple[str, ...]
    means: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]  # one row per component
    ratios: tuple[float, ...]

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``PC1..`` per row as plain column arithmetic, next to the kept columns."""
        centred = [col(c).cast("double") - F.lit(m) for c, m in zip(self.cols, self.means)]
        parts = [
            reduce(add, [x * F.lit(w) for x, w in zip(centred, weights)]).alias(f"PC{i + 1}")
            for i, weights in enumerate(self.loadings)
        ]
        return df.select(*[col(k) for k in keep], *parts)

    def explained(self, spark) -> DataFrame:
        rows = [(f"PC{i + 1}", float(r)) for i, r in enumerate(self.ratios)]
        return spark.createDataFrame(rows, "component string, ratio double")


def fit_components(df: DataFrame, cols: Sequence[str], n_components: int = 3) -> Components:
    """Centred, unscaled components of the rows complete in ``cols``.

    One pass builds the covariance; the columns x columns eigenproblem is solved here.
    The largest loading of a component is made positive.
    """
    p = len(cols)
    moments = pair_moments(complete_rows(df.select(*[col(c) for c in cols])), cols).collect()
    cov, means = np.zeros((p, p)), [0.0] * p
    for r in moments:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cij"] / max(r["n"] - 1, 1)
        means[r["i"]], means[r["j"]] = r["mean_i"], r["mean_j"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: min(n_components, p)]
    total = float(values.sum()) or 1.0
    loadings = []
    for k in order:
        v = vectors[:, k]
        v = v * (1.0 if v[np.abs(v).argmax()] >= 0 else -1.0)
        loadings.append(tuple(float(x) for x in v))
    return Components(tuple(cols), tuple(means), tuple(loadings), tuple(float(values[k]) / total for k in order))
