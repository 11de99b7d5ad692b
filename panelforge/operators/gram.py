"""Pairwise-complete second moments of many columns in one pass.

Each task keeps one small matrix per sum (columns x columns) over its Arrow batches and
emits it once; the merge is a shuffle of columns^2 rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col

PARTIAL_SCHEMA = "i int, j int, n double, mi double, mj double, cii double, cjj double, cij double"


def _partials(p: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = None
        n = s = q = c = np.zeros((p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            if not len(x):
                continue
            mask = np.isfinite(x)
            if shift is None:
                counts = mask.sum(axis=0)
                shift = np.where(mask, x, 0.0).sum(axis=0) / np.maximum(counts, 1)
            x = np.where(mask, x - shift, 0.0)
            m = mask.astype(float)
            n = n + m.T @ m
            s = s + x.T @ m
            q = q + (x * x).T @ m
            c = c + x.T @ x
        if shift is None:
            return
        i, j = np.triu_indices(p)
        n_ij = n[i, j]
        ok = n_ij > 0
        i, j, n_ij = i[ok], j[ok], n_ij[ok]
        si, sj = s[i, j], s[j, i]
        yield pd.DataFrame(
            {
                "i": i.astype(np.int32),
                "j": j.astype(np.int32),
                "n": n_ij,
                "mi": shift[i] + si / n_ij,
                "mj": shift[j] + sj / n_ij,
                "cii": q[i, j] - si * si / n_ij,
                "cjj": q[j, i] - sj * sj / n_ij,
                "cij": c[i, j] - si * sj / n_ij,
            }
        )

    return run


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, mean_i, mean_j, cii, cjj, cij) for i <= j: means and centred sums."""
    slim = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    partial = slim.mapInPandas(_partials(len(cols)), PARTIAL_SCHEMA)
    pair = Window.partitionBy("i", "j")
    mean_i = F.sum(F.col("n") * F.col("mi")).over(pair) / F.sum("n").over(pair)
    mean_j = F.sum(F.col("n") * F.col("mj")).over(pair) / F.sum("n").over(pair)
    centred = partial.withColumn("gi", mean_i).withColumn("gj", mean_j)
    di, dj = F.col("mi") - F.col("gi"), F.col("mj") - F.col("gj")
    return centred.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.max("gi").alias("mean_i"),
        F.max("gj").alias("mean_j"),
        F.sum(F.col("cii") + F.col("n") * di * di).alias("cii"),
        F.sum(F.col("cjj") + F.col("n") * dj * dj).alias("cjj"),
        F.sum(F.col("cij") + F.col("n") * di * dj).alias("cij"),
    )


def named(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, value) with i <= j to the full (col_i, col_j, value) matrix."""
    names = F.array(*[F.lit(c) for c in cols])
    sides = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    both = matrix.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s"), "value")
    return both.select(names[F.col("s.a")].alias("col_i"), names[F.col("s.b")].alias("col_j"), "value")
