"""Correlation matrices in long form: (col_i, col_j, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .buckets import ROWS_PER_BUCKET
from .concordance import pair_sums
from .gram import named, pair_moments
from .quantiles import long_form
from .ranks import order_statistics


def _clamped(c: Column) -> Column:
    """Within -1..1; NULL stays NULL, which least and greatest alone would lose."""
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def _ratio(moments: DataFrame) -> DataFrame:
    scale = F.sqrt(F.col("cii")) * F.sqrt(F.col("cjj"))
    value = F.when((F.col("cii") > 0) & (F.col("cjj") > 0), F.try_divide(F.col("cij"), scale))
    clamped = F.when((F.col("i") == F.col("j")) & value.isNotNull(), F.lit(1.0)).otherwise(_clamped(value))
    return moments.select("i", "j", clamped.alias("value"))


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise complete; NULL where a column is constant."""
    return named(_ratio(pair_moments(df, cols)), cols)


def spearman(df: DataFrame, cols: Sequence[str], key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pearson of average ranks over the rows complete in ``cols``."""
    stats = order_statistics(df, key, cols, rows_per_bucket)
    return named(_ratio(pair_moments(stats, [f"r{i}" for i in range(len(cols))])), cols)


def kendall(df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, found: tuple | None = None) -> DataFrame:
    """Tau-b over the rows complete in ``cols``; NULL where a column is constant.

    ``found`` are the ``pair_sums`` of the frame when they are known already.
    """
    sums, ties, n = found or pair_sums(df, cols, rows_per_bucket)
    pairs = float(n) * (n - 1) / 2
    free = ties.select("c", (F.lit(pairs) - F.col("t")).alias("f"))
    # one row per column
    a = F.broadcast(free.select(F.col("c").alias("i"), F.col("f").alias("fi")))
    b = F.broadcast(free.select(F.col("c").alias("j"), F.col("f").alias("fj")))
    scale = F.sqrt("fi") * F.sqrt("fj")
    off = sums.join(a, "i").join(b, "j").select("i", "j", _clamped(F.try_divide(F.col("k"), scale)).alias("value"))
    value = F.when(F.col("f") > 0, F.lit(1.0))
    diagonal = free.select(F.col("c").alias("i"), F.col("c").alias("j"), value.alias("value"))
    return named(off.unionAll(diagonal), cols)


def distance_correlation(
    df: DataFrame, cols: Sequence[str], key: str, rows_per_bucket: int = ROWS_PER_BUCKET, found: tuple | None = None
) -> DataFrame:
    """Biased (V-statistic) distance correlation, diagonal 1, 0 where a column is constant; ``found`` as in ``kendall``."""
    sums, _, n = found or pair_sums(df, cols, rows_per_bucket)
    p = len(cols)
    stats = order_statistics(df, key, cols, rows_per_bucket)
    # centred second moments of values and of distance sums, one pass each row
    moments = pair_moments(stats, [*[f"a{i}" for i in range(p)], *[f"v{i}" for i in range(p)]])
    m = float(n)
    row_sums = moments.where(F.col("j") < p)
    # mean over pairs of a_ij^2 is twice the variance of x; each sum is kept centred
    diagonal = row_sums.where("i = j").select(
        F.col("i").alias("c"), (F.col("cij") / m).alias("va"), (F.col("mean_i") / m).alias("grand")
    )
    values = moments.where((F.col("i") == F.col("j")) & (F.col("i") >= p)).select(
        (F.col("i") - p).alias("c"), (F.col("cij") / m).alias("vx")
    )
    spread = diagonal.join(F.broadcast(values), "c").select(
        "c",
        "grand",
        F.greatest(
            2.0 * F.col("vx") + F.col("grand") * F.col("grand")
            - 2.0 * (F.col("va") / (m * m) + F.col("grand") * F.col("grand")),
            F.lit(0.0),
        ).alias("dvar"),
    )
    cross = row_sums.where("i < j").select("i", "j", (F.col("cij") / m).alias("ab"))
    a = F.broadcast(spread.select(F.col("c").alias("i"), F.col("grand").alias("gi"), F.col("dvar").alias("di")))
    b = F.broadcast(spread.select(F.col("c").alias("j"), F.col("grand").alias("gj"), F.col("dvar").alias("dj")))
    product = F.col("gi") * F.col("gj")
    dcov = 2.0 * F.col("d") / (m * m) + product - 2.0 * (F.col("ab") / (m * m) + product)
    scale = F.sqrt(F.col("di")) * F.sqrt(F.col("dj"))
    value = F.coalesce(F.sqrt(F.greatest(F.try_divide(dcov, scale), F.lit(0.0))), F.lit(0.0))
    off = sums.join(cross, ["i", "j"]).join(a, "i").join(b, "j").select("i", "j", F.least(value, F.lit(1.0)).alias("value"))
    ones = spread.select(F.col("c").alias("i"), F.col("c").alias("j"), F.lit(1.0).alias("value"))
    return named(off.unionAll(ones), cols)


def variance_vector(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Sample variance per column."""
    variance = F.bround(F.var_samp("value"), digits) + F.lit(0.0)
    return long_form(df, cols).groupBy("column").agg(variance.alias("variance"))
