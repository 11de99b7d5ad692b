"""Tables behind the exploration plots: histograms, density curves and scatter samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, number
from .quantiles import long_form
from .sampling import stratified_sample

GRID_POINTS = 200
CUT = 3.0


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """(column, bin, low, high, count) over equal-width bins between each column's limits."""
    long = long_form(df, cols).where(F.col("value").isNotNull())
    # one row per column
    limits = F.broadcast(long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")))
    width = (F.col("b") - F.col("a")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("a"), width)), F.lit(0))
    binned = long.join(limits, "column").withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    counted = binned.groupBy("column", "bin", "a", "b").agg(F.count(F.lit(1)).alias("count"))
    low = F.col("a") + F.col("bin") * width
    return counted.select("column", "bin", low.alias("low"), (low + width).alias("high"), "count")


def density_curve(df: DataFrame, cols: Sequence[str], points: int = GRID_POINTS) -> DataFrame:
    """(column, point, x, density): Gaussian kernel density with Scott's bandwidth.

    Each task sums the kernels of its rows on the grid, so only grid-sized partial sums
    are shuffled.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = number(col(c))
        aggs += [F.count(x).alias(f"n{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    usable, grids, widths, counts = [], [], [], []
    for i, c in enumerate(cols):
        n, s = row[f"n{i}"], row[f"s{i}"]
        if not n or not s:
            continue
        h = s * n ** (-0.2)
        usable.append(c)
        widths.append(h)
        counts.append(n)
        grids.append(np.linspace(row[f"a{i}"] - CUT * h, row[f"b{i}"] + CUT * h, points))
    slim = df.select(*[number(col(c)).alias(f"c{i}") for i, c in enumerate(usable)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(usable), points))
        for batch in batches:
            for i in range(len(usable)):
                x = batch[f"c{i}"].to_numpy(dtype=float)
                x = x[np.isfinite(x)]
                for s in range(0, len(x), 10_000):
                    z = (grids[i][:, None] - x[None, s : s + 10_000]) / widths[i]
                    sums[i] += np.exp(-0.5 * z * z).sum(axis=1)
        for i, c in enumerate(usable):
            yield pd.DataFrame(
                {"column": c, "point": np.arange(points, dtype=np.int32), "x": grids[i], "part": sums[i] / (counts[i] * widths[i] * np.sqrt(2 * np.pi))}
            )

    partial = slim.mapInPandas(run, "column string, point int, x double, part double")
    return partial.groupBy("column", "point", "x").agg(F.sum("part").alias("density"))


def scatter_sample(
    df: DataFrame, cols: Sequence[str], stratum: str, key: str, fraction: float = 0.1, extra: Sequence[str] = ()
) -> DataFrame:
    """Sampled rows of the plotted columns, with the extra columns beside them."""
    sample = stratified_sample(df, stratum, key, fraction)
    return sample.select(col(key), *[col(c) for c in extra], *[col(c) for c in cols])


def scatter_pairs(
    df: DataFrame, cols: Sequence[str], stratum: str, key: str, fraction: float = 0.1
) -> DataFrame:
    """(key, x_col, y_col, x, y) for every column pair of the sampled rows."""
    sample = scatter_sample(df, cols, stratum, key, fraction)
    values = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("v")) for c in cols])
    first = sample.select(col(key), values.alias("_all")).select(col(key), "_all", F.posexplode("_all").alias("_i", "_a"))
    both = first.select(col(key), "_a", F.explode(F.slice("_all", F.col("_i") + 2, F.lit(len(cols)))).alias("_b"))
    return both.select(col(key), F.col("_a.name").alias("x_col"), F.col("_b.name").alias("y_col"), F.col("_a.v").alias("x"), F.col("_b.v").alias("y"))
