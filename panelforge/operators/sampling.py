"""Exact stratified sampling in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SAMPLE_FRACTION, SEED
from ..functions.scalars import col
from ..session import broadcast_if_small, store

#: Hash digits by which a cutting prefix grows, and the rows under it that are few enough to rank.
DIGITS = 3
RANKED_ROWS = 10_000
HASH_DIGITS = 32


def stratified_sample(
    df: DataFrame, stratum: str, key: str, fraction: float = SAMPLE_FRACTION, seed: int = SEED, ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """Exactly floor(fraction * n) rows of every stratum, those with the smallest hashes.

    The hash is md5 of ``key|seed``; ``key`` must be unique. Rows counted per hash prefix tell
    which prefix holds a stratum's last sampled row. Under that prefix alone the next digits are
    counted, until at most ``ranked_rows`` rows of a stratum are left to rank, however large the
    stratum is. Rows without a stratum are left out.
    """
    if fraction >= 1.0:
        return df.where(col(stratum).isNotNull())
    digest = F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")))
    hashed = df.where(col(stratum).isNotNull()).withColumn("_hash", digest)
    slim = hashed.select(col(stratum).alias("_stratum"), "_hash", col(key).alias("_key"))
    last = cutting_prefixes(slim, fraction, ranked_rows)
    order = Window.partitionBy("_stratum").orderBy("_hash", "_key")
    under = slim.join(last, "_stratum").where(F.col("_hash").startswith(F.col("_prefix")))
    cutoff = (
        under.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == F.col("_take"))
        .select("_stratum", F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key"))
    )
    # one row per stratum; the count inside the hint keeps an unbounded stratum column safe
    kept = hashed.join(broadcast_if_small(cutoff), col(stratum) == F.col("_stratum")).where(
        (F.col("_hash") < F.col("_cut_hash"))
        | ((F.col("_hash") == F.col("_cut_hash")) & (col(key) <= F.col("_cut_key")))
    )
    return kept.select(*[col(c) for c in df.columns])


def cutting_prefixes(slim: DataFrame, fraction: float, ranked_rows: int) -> DataFrame:
    """(_stratum, _prefix, _take, _rows): the prefix that the last sampled row's hash starts with.

    ``_take`` counts the sampled rows under it, ``_rows`` all rows under it. Strata without a
    sampled row have none. Rows whose whole hashes are equal stay together.
    """
    total = F.sum("_c").over(Window.partitionBy("_stratum"))
    first = slim.groupBy("_stratum", F.substring("_hash", 1, DIGITS).alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"))
    last = store(_cut(first.withColumn("_want", F.floor(F.lit(float(fraction)) * total).cast("long"))))
    length = DIGITS
    while length < HASH_DIGITS and not last.where(F.col("_rows") > ranked_rows).isEmpty():
        length = min(length + DIGITS, HASH_DIGITS)
        under = slim.join(broadcast_if_small(last), "_stratum").where(F.col("_hash").startswith(F.col("_prefix")))
        counted = under.groupBy("_stratum", F.col("_take").alias("_want"), F.substring("_hash", 1, length).alias("_prefix"))
        last = store(_cut(counted.agg(F.count(F.lit(1)).alias("_c"))))
    return broadcast_if_small(last)


def _cut(counted: DataFrame) -> DataFrame:
    """The prefix in which a stratum's running count reaches what is wanted; 16^DIGITS rows a stratum."""
    upto = F.sum("_c").over(Window.partitionBy("_stratum").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_upto", upto).where((F.col("_want") > F.col("_upto") - F.col("_c")) & (F.col("_want") <= F.col("_upto")))
    return placed.select("_stratum", "_prefix", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_take"), F.col("_c").alias("_rows"))
