"""Column expressions and small frame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import is_small, store

#: The six ASCII characters that count as space: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest side that is ever hinted as a broadcast: rows, and bytes of its widest possible content.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """The text without any of the six space characters; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of words in the text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def side(stored: DataFrame, size: Column | None = None) -> DataFrame:
    """Hint a broadcast of a stored frame only if its rows and bytes are within the bound.

    ``size`` gives the bytes of a row's texts; fixed-width rows need none. Beyond the bound
    the join is a shuffle join, where adaptive execution splits a skewed key.
    """
    if not is_small(stored, BROADCAST_ROWS):
        return stored
    width = F.lit(8 * len(stored.columns)) + (F.coalesce(size, F.lit(0)) if size is not None else F.lit(0))
    bytes_ = stored.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(stored) if bytes_ <= BROADCAST_BYTES else stored


def row_order(df: DataFrame) -> Column:
    """The row as a value that windows can order by; maps have no order, so a row with any counts as its JSON."""

    def holds_map(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(holds_map(f.dataType) for f in t.fields)
        return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and holds_map(t.elementType)

    return F.to_json(packed(df)) if holds_map(df.schema) else packed(df)


def most_frequent(counted: DataFrame, count: str, most: int, tie: str) -> DataFrame:
    """At most ``most`` rows with the largest counts: as many whole bands of counts as fit.

    Bands are quarters of an octave, so all of the table is read, but only the chosen rows are
    gathered. Only if the first band alone is too large its rows are ordered.
    """
    band = F.floor(F.log2(F.col(count)) * 4)
    sizes = counted.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect()
    total, lowest = 0, None
    for r in sizes:  # at most 256 bands
        if total + r["n"] > most:
            break
        total, lowest = total + r["n"], r["band"]
    if lowest is not None:
        return counted.where(band >= lowest)
    return counted.orderBy(F.desc(count), tie).limit(most)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the global position (from 0) in ``order`` without sorting in one task.

    A range shuffle deals the rows, each partition numbers its own, and the sizes of the
    partitions (one row each) give the offsets.
    """
    ranged = store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_row", "_before")
    )
