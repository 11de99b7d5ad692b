"""Studies of stored matrices: norms, run differences, eigenvalues."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 4


def _rounded(c):
    return F.bround(c, DIGITS) + F.lit(0.0)


def matrix_norms(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Off-diagonal absolute sum and mean, and Frobenius norm, per run."""
    off = F.when(F.col("col_i") != F.col("col_j"), F.abs("value"))
    sums = matrix.groupBy(*by).agg(
        F.coalesce(F.sum(off), F.lit(0.0)).alias("off"),
        F.count_if(F.col("col_i") != F.col("col_j")).alias("n"),
        F.sum(F.col("value") * F.col("value")).alias("sq"),
    )
    total = _rounded(F.col("off"))
    return sums.select(
        *by,
        total.alias("sum"),
        _rounded(F.try_divide(total, F.col("n"))).alias("avg"),
        _rounded(F.sqrt("sq")).alias("fro"),
    )


def run_differences(norms: DataFrame, run: str = "run", value: str = "fro") -> DataFrame:
    """Change of a norm between successive runs and from the first to the last."""
    order = Window.partitionBy(F.lit(0)).orderBy(run)  # one row per run
    steps = norms.select(
        F.lag(run).over(order).alias("from_run"), F.col(run).alias("to_run"), (F.col(value) - F.lag(value).over(order)).alias("d")
    ).where(F.col("from_run").isNotNull())
    ends = norms.agg(
        F.min(run).alias("from_run"),
        F.max(run).alias("to_run"),
        (F.max_by(value, run) - F.min_by(value, run)).alias("d"),
    )
    span = norms.agg(F.count(F.lit(1)).alias("_n"))
    whole = ends.join(F.broadcast(span), F.col("_n") > 2).select("from_run", "to_run", "d")
    return steps.unionAll(whole).select("from_run", "to_run", _rounded(F.col("d")).alias("difference"))


def eigenvalues(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(k, eigenvalue), largest first. The matrix is columns x columns; that solve is local."""
    place = {c: i for i, c in enumerate(cols)}
    dense = np.zeros((len(cols), len(cols)))
    for r in matrix.collect():
        dense[place[r["col_i"]], place[r["col_j"]]] = r["value"] if r["value"] is not None else 0.0
    values = np.sort(np.linalg.eigvalsh((dense + dense.T) / 2))[::-1]
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    return matrix.sparkSession.createDataFrame(rows, "k int, eigenvalue double")


def variance_explained(values: DataFrame) -> DataFrame:
    """Share and cumulated share of each eigenvalue, in the order of k."""
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = values.select("k", "eigenvalue", (F.col("eigenvalue") / F.sum("eigenvalue").over(every)).alias("proportion"))
    return share.select("*", F.sum("proportion").over(upto).alias("cumulative"))
