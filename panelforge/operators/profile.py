"""Column quality report, describe table and row audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col, normalize_missing, numeric_columns
from .quantiles import ACCURACY, grouped_quantiles, long_form


#: Longer strings are counted by a hash; it is longer itself, so it equals no shorter string.
HASHED_BYTES = 32


def _value_class(dtype: T.DataType) -> str:
    """The type a column's values are compared in; lossless for each class."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return dtype.simpleString()
    return "string"


def _by_class(df: DataFrame) -> dict[str, list[str]]:
    classes: dict[str, list[str]] = {}
    for field in df.schema.fields:
        classes.setdefault(_value_class(field.dataType), []).append(field.name)
    return classes


def value_counts_long(df: DataFrame) -> DataFrame:
    """(column, missing, zero, n): one row per distinct value, value itself dropped.

    Equal values meet through a combining aggregate on (column, value), so a value that
    fills most of a column is already one row per input partition before the shuffle.
    """
    df = normalize_missing(df)
    parts = []
    for dtype, cols in _by_class(df).items():
        long = long_form(df, cols, dtype=dtype)
        if dtype == "string":  # long texts are told apart by their hash, so they are never shuffled
            value = F.col("value")
            long = long.withColumn("value", F.when(F.octet_length(value) > HASHED_BYTES, F.sha2(value, 256)).otherwise(value))
        zero = F.col("value") == 0 if dtype in ("bigint", "double") or dtype.startswith("decimal") else F.lit(False)
        counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counted.select(
                "column", F.col("value").isNull().alias("missing"), F.coalesce(zero, F.lit(False)).alias("zero"), "n"
            )
        )
    return reduce(DataFrame.unionAll, parts)


def _percent(count, total):
    return F.bround(F.coalesce(F.try_divide(count.cast("double"), total) * 100.0, F.lit(0.0)), 2)


def quality_report(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, zero, missing, duplicate and unique counts with percentages."""
    if approximate:
        counts = _approximate_counts(df)
    else:
        counts = (
            value_counts_long(df)
            .groupBy("column")
            .agg(
                F.sum("n").alias("total"),
                F.coalesce(F.sum(F.when(F.col("zero"), F.col("n"))), F.lit(0)).alias("zero_count"),
                F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing_count"),
                F.count_if(~F.col("missing")).alias("unique_count"),
            )
        )
    types = F.create_map(
        *[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    )
    total = F.col("total")
    duplicates = total - F.col("unique_count") - (F.col("missing_count") > 0).cast("long")
    return counts.withColumn("duplicate_count", duplicates).select(
        "column",
        types[F.col("column")].alias("data_type"),
        "zero_count",
        _percent(F.col("zero_count"), total).alias("zero_percentage"),
        "missing_count",
        _percent(F.col("missing_count"), total).alias("missing_percentage"),
        "duplicate_count",
        _percent(F.col("duplicate_count"), total).alias("duplicate_percentage"),
        "unique_count",
        _percent(F.col("unique_count"), total).alias("unique_percentage"),
    )


def _approximate_counts(df: DataFrame) -> DataFrame:
    df = normalize_missing(df)
    parts = []
    for dtype, cols in _by_class(df).items():
        zero = F.count_if(F.col("value") == 0) if dtype in ("bigint", "double") else F.lit(0).cast("long")
        parts.append(
            long_form(df, cols, dtype=dtype)
            .groupBy("column")
            .agg(
                F.count(F.lit(1)).alias("total"),
                zero.alias("zero_count"),
                F.count_if(F.col("value").isNull()).alias("missing_count"),
                F.approx_count_distinct("value").alias("unique_count"),
            )
        )
    return reduce(DataFrame.unionAll, parts)


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2, accuracy: int = ACCURACY) -> DataFrame:
    """count, mean, std, min, quartiles and max of the numeric columns, quartiles exact."""
    cols = list(cols or numeric_columns(df))
    long = long_form(normalize_missing(df), cols)
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = (
        grouped_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], accuracy)
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            ]
        )
    )
    out = moments.join(quartiles, "column", "left")
    measures = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return out.select("column", "count", *[(F.bround(m, digits) + F.lit(0.0)).alias(m) for m in measures])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while another action runs; read ``observation.get`` afterwards."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def shape_audit(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(step, stage, n_rows, n_cols) for a sequence of stages."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
        )
        for i, (name, df) in enumerate(stages.items())
    ]
    return reduce(DataFrame.unionAll, parts)
