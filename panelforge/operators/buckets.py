"""Where every distinct value of a column stands, and value-ordered buckets of bounded size.

Both come from one table of distinct values with their counts: equal values meet already combined,
so a value that fills a column is a single row, and a range shuffle with running sums inside its
partitions places them all. No limits are gathered. A bucket holds at most about two times
``rows_per_bucket`` rows; a value too frequent for that is a bucket of its own ("single"), whose
rows tie with each other, so no operator here has to gather them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col, complete_rows
from ..session import store

ROWS_PER_BUCKET = 250_000
#: Partitions of the range shuffle of distinct values, at most.
RANGES = 10_000
#: From so many ranges on, a range holds at least so many rows: smaller ones would cost more to start than to sort.
MANY_RANGES, RANGE_ROWS = 200, 50_000


@dataclass(frozen=True)
class Buckets:
    frame: DataFrame  # keep columns, v0.. (double, not NULL) and b0.. (int)
    n: int
    width: int
    #: Most bucket numbers of any column; 1 when nothing is split.
    count: int
    #: Whether some column has a one-value bucket.
    any_single: bool

    def is_single(self, bucket: Column) -> Column:
        """One-value buckets have odd numbers."""
        return bucket % 2 == 1


def long_values(df: DataFrame, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., c, v): a row per value of ``v0``.. ."""
    entries = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(width)])
    return df.select(*keep, F.inline(entries))


def range_count(rows: int, rows_per_range: int) -> int:
    """Ranges that the distinct values are shuffled into; their number changes no result."""
    return max(1, min(RANGES, math.ceil(rows / rows_per_range), max(MANY_RANGES, math.ceil(rows / RANGE_ROWS))))


def value_positions(long: DataFrame, rows: int, rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """(c, v, n, lower, s_lower, nn, ss) per distinct value of (c, v) rows, stored.

    ``lower`` and ``s_lower`` are the number and sum of all lower values of the column, ``nn`` and
    ``ss`` those of the whole column.
    """
    distinct = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ranges = range_count(rows, rows_per_range)
    ranged = store(distinct.repartitionByRange(ranges, "c", "v").withColumn("part", F.spark_partition_id()))
    total = ranged.groupBy("c", "part").agg(F.sum("n").alias("pn"), F.sum(F.col("n") * F.col("v")).alias("ps"))
    column = Window.partitionBy("c")
    before = column.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row per column and range
    offsets = total.select(
        "c",
        "part",
        F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("ps").over(before), F.lit(0.0)).alias("s0"),
        F.sum("pn").over(column).alias("nn"),
        F.sum("ps").over(column).alias("ss"),
    )
    inside = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n0")
    s_lower = F.coalesce(F.sum(F.col("n") * F.col("v")).over(inside), F.lit(0.0)) + F.col("s0")
    placed = ranged.join(F.broadcast(offsets), ["c", "part"])
    return store(placed.select("c", "v", "n", lower.alias("lower"), s_lower.alias("s_lower"), "nn", "ss"))


def value_buckets(
    df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> Buckets:
    """Bucket the complete rows of ``cols``; nothing is shuffled when one bucket holds them all.

    A value's bucket follows from the number of lower values, so buckets are ordered like values.
    """
    width = len(cols)
    names = [f"v{i}" for i in range(width)]
    slim = complete_rows(df.select(*[col(k).alias(k) for k in keep], *[col(c).cast("double").alias(v) for c, v in zip(cols, names)]))
    n = slim.count()
    if n <= rows_per_bucket:
        return Buckets(slim.select("*", *[F.lit(0).alias(f"b{i}") for i in range(width)]), n, width, 1, False)
    slim = store(slim.withColumn("_uid", F.monotonically_increasing_id()))
    long = long_values(slim, width, ["_uid"])
    single = F.col("n") > rows_per_bucket
    bucket = 2 * F.floor(F.col("lower") / rows_per_bucket) + F.when(single, 1).otherwise(0)
    codes = store(value_positions(long.select("c", "v"), n * width, rows_per_bucket).select("c", "v", bucket.cast("int").alias("b")))
    seen = codes.agg(F.max("b").alias("most"), F.bool_or(F.col("b") % 2 == 1).alias("single")).first()
    # a hot value joins one row, on whose side adaptive execution splits
    picks = [F.max(F.when(F.col("c") == i, F.col("b"))).alias(f"b{i}") for i in range(width)]
    of_row = long.join(codes, ["c", "v"]).groupBy("_uid").agg(*picks)
    framed = slim.join(of_row, "_uid").select(*[col(k) for k in keep], *names, *[f"b{i}" for i in range(width)])
    return Buckets(store(framed), n, width, seen["most"] + 1, bool(seen["single"]))
