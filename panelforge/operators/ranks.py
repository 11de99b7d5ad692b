"""Order statistics of every value in its column: average ranks and distance sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, complete_rows
from ..session import store
from .buckets import ROWS_PER_BUCKET, long_values, value_positions


def order_statistics(
    df: DataFrame, key: str, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Per row: key, values ``v0..``, average ranks ``r0..`` and distance sums ``a0..``.

    ``a`` is the sum of |x - y| over all rows y. Only rows complete in ``cols`` take part; rows
    that share a key stay apart. All follows from a value's place among the distinct values of its
    column, so rows meet one row per value and no window holds rows.
    """
    width = len(cols)
    values = [col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]
    slim = complete_rows(df.select(col(key).alias("_key"), *values))
    slim = store(slim.withColumn("_uid", F.monotonically_increasing_id()))
    long = long_values(slim, width, ["_uid"])
    places = value_positions(long.select("c", "v"), slim.count() * width, rows_per_bucket)
    v, le = F.col("v"), F.col("lower") + F.col("n")
    sle = F.col("s_lower") + F.col("n") * v
    scored = long.join(places, ["c", "v"]).select(
        "_uid",
        "c",
        (F.col("lower") + (F.col("n") + 1) / 2.0).alias("r"),
        (v * le - sle + (F.col("ss") - sle) - v * (F.col("nn") - le)).alias("a"),
    )
    picks = [F.max(F.when(F.col("c") == i, F.col(m))).alias(f"{m}{i}") for m in ("r", "a") for i in range(width)]
    found = scored.groupBy("_uid").agg(*picks)
    names = [f"v{i}" for i in range(width)]
    return slim.join(found, "_uid").select(
        F.col("_key").alias(key), *names, *[f"{m}{i}" for m in ("r", "a") for i in range(width)]
    )
