"""Row filters that drop outliers, and their chain."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StudySettings
from ..functions.scalars import col, number
from ..session import broadcast_if_small, store
from .dbscan import noise_points
from .forest import anomaly_scores
from .neighbors import CELL_ROWS, join_points, local_outlier_factor, point_condition, weighted_points
from .quantiles import ACCURACY, column_quantiles, grouped_quantiles, long_form

BUCKET_ROWS = 50_000


def _all(tests):
    keep = F.lit(True)
    for t in tests:
        keep = keep & t
    return keep


def _z_within(x, mean, std, threshold: float):
    """Below the threshold; a constant column or a missing value never drops a row."""
    z = F.abs(F.try_divide(x - mean, std))
    return F.coalesce(z < F.lit(float(threshold)), F.lit(True))


def zscore_filter(df: DataFrame, cols: Sequence[str], threshold: float = 12.0, group_cols: Sequence[str] = ()) -> DataFrame:
    """Keep rows with |z| < threshold in every column; population deviation."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(number(col(c))).alias(f"_m{i}"), F.stddev_pop(number(col(c))).alias(f"_s{i}")]
    if not group_cols:
        row = df.agg(*aggs).first()
        stats = [(row[f"_m{i}"], row[f"_s{i}"]) for i in range(len(cols))]
        return df.where(
            _all(_z_within(number(col(c)), F.lit(m), F.lit(s), threshold) for c, (m, s) in zip(cols, stats) if m is not None)
        )
    keys = [f"_k{i}" for i in range(len(group_cols))]
    stats = df.groupBy(*[col(g).alias(k) for g, k in zip(group_cols, keys)]).agg(*aggs)
    on = _all(col(g).eqNullSafe(F.col(k)) for g, k in zip(group_cols, keys))
    joined = df.join(broadcast_if_small(stats), on)
    kept = joined.where(_all(_z_within(number(col(c)), F.col(f"_m{i}"), F.col(f"_s{i}"), threshold) for i, c in enumerate(cols)))
    return kept.select(*[col(c) for c in df.columns])


def _between(x, low, high):
    """Inside the fences, which count as inside; missing values stay."""
    return F.coalesce((x >= low) & (x <= high), F.lit(True))


def iqr_filter(
    df: DataFrame,
    cols: Sequence[str],
    factor: float = 6.0,
    quantiles: tuple[float, float] = (0.05, 0.95),
    group_cols: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Keep rows inside q_low - factor * range .. q_high + factor * range in every column."""
    if not group_cols:
        found = column_quantiles(df, cols, quantiles, accuracy)
        tests = []
        for c in cols:
            low, high = found[c]
            if low is None:
                continue
            spread = high - low
            tests.append(_between(number(col(c)), F.lit(low - factor * spread), F.lit(high + factor * spread)))
        return df.where(_all(tests))
    keys = [f"_k{i}" for i in range(len(group_cols))]
    renamed = df.select(*[col(g).alias(k) for g, k in zip(group_cols, keys)], *[col(c) for c in cols])
    found = grouped_quantiles(long_form(renamed, cols, keys), [*keys, "column"], "value", quantiles, accuracy)
    picks = []
    for i, c in enumerate(cols):
        here = F.col("column") == c
        for name, p in (("_lo", quantiles[0]), ("_hi", quantiles[1])):
            picks.append(F.max(F.when(here & (F.col("prob") == float(p)), F.col("quantile"))).alias(f"{name}{i}"))
    fences = found.groupBy(*keys).agg(*picks)
    on = _all(col(g).eqNullSafe(F.col(k)) for g, k in zip(group_cols, keys))
    joined = df.join(broadcast_if_small(fences), on, "left")
    tests = []
    for i, c in enumerate(cols):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        spread = high - low
        tests.append(_between(number(col(c)), low - F.lit(factor) * spread, high + F.lit(factor) * spread))
    return joined.where(_all(tests)).select(*[col(c) for c in df.columns])


def lof_scores(df: DataFrame, cols: Sequence[str], key: str, k: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``_lof``; NULL for rows incomplete in ``cols``.

    The frame is stored first, so that rows and points hold the very same numbers.
    """
    df = store(df)
    points = store(weighted_points(df, key, cols))
    scores = store(local_outlier_factor(points, len(cols), k, cell_rows))
    xs = [f"x{i}" for i in range(len(cols))]
    per_point = points.join(scores, "id").select(*xs, F.col("lof").alias("_lof"))
    return join_points(df, cols, per_point)


def lof_filter(df: DataFrame, cols: Sequence[str], key: str, k: int = 20, contamination: float = 0.05, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Drop the rows whose local outlier factor lies in the top share."""
    scored = store(lof_scores(df, cols, key, k, cell_rows).withColumn("_nof", -F.col("_lof")))
    offset = column_quantiles(scored, ["_nof"], [contamination])["_nof"][0]
    kept = scored if offset is None else scored.where(F.coalesce(F.col("_nof") >= F.lit(offset), F.lit(True)))
    return kept.drop("_lof", "_nof")


def isolation_filter(df: DataFrame, cols: Sequence[str], key: str, contamination: float = 0.01, seed: int = 42) -> DataFrame:
    """Drop the rows with the highest isolation-forest scores."""
    scored = store(anomaly_scores(df, key, cols, seed=seed).withColumn("_neg", -F.col("_score")))
    offset = column_quantiles(scored, ["_neg"], [contamination])["_neg"][0]
    kept = scored if offset is None else scored.where(F.coalesce(F.col("_neg") >= F.lit(offset), F.lit(True)))
    return kept.drop("_score", "_neg")


def noise_filter(df: DataFrame, cols: Sequence[str], key: str, eps: float = 0.5, min_samples: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Drop rows that density clustering calls noise."""
    df = store(df)
    noise = store(noise_points(df, key, cols, eps, min_samples, cell_rows))
    on, names = point_condition(cols)
    return df.join(noise.withColumnsRenamed(names), on, "left_anti")


def drop_outliers(df: DataFrame, cols: Sequence[str], method: str, key: str, settings: StudySettings | None = None) -> DataFrame:
    """One filter by name: zscore, iqr, iso, lof or dbscan."""
    s = settings or StudySettings()
    filters: dict[str, Callable[[], DataFrame]] = {
        "zscore": lambda: zscore_filter(df, cols, s.deviation.limit),
        "iqr": lambda: iqr_filter(df, cols, s.fence.reach, (s.fence.low, s.fence.high)),
        "iso": lambda: isolation_filter(df, cols, key, s.forest.dropped, s.forest.seed),
        "lof": lambda: lof_filter(df, cols, key, s.local.neighbours, s.local.dropped),
        "dbscan": lambda: noise_filter(df, cols, key, s.density.radius, s.density.rows),
    }
    if method not in filters:
        raise ValueError(f"unknown outlier method {method!r}")
    return filters[method]()


def outlier_chain(df: DataFrame, cols: Sequence[str], key: str, settings: StudySettings | None = None) -> DataFrame:
    """The configured filters in order, each stored before the next reads it."""
    settings = settings or StudySettings()
    for method in settings.filters:
        df = store(drop_outliers(df, cols, method, key, settings))
    return df


def bucket_filter(
    df: DataFrame,
    cols: Sequence[str],
    key: str,
    mask: Callable[[pd.DataFrame], np.ndarray],
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Filter by a function of bounded row buckets: pandas frame of ``cols`` in, keep-mask out.

    Buckets are hashes of the unique key, so none grows with skew and the result does not
    depend on how the frame happens to be partitioned.
    """
    buckets = max(1, math.ceil(df.count() / bucket_rows))
    names = list(cols)
    keyed = df.select(col(key).alias("_key"), *[col(c).cast("double").alias(c) for c in names]).withColumn(
        "_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets))
    )
    key_type = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        keep = np.asarray(mask(pdf[names]), dtype=bool)
        return pdf.loc[keep, ["_key"]]

    kept = keyed.groupBy("_bucket").applyInPandas(run, f"_key {key_type}")
    return df.join(kept, col(key) == F.col("_key"), "left_semi")
