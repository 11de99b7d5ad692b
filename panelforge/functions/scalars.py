"""Row-wise expressions. Missing means NULL; no expression emits NaN or infinity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATIO_EPS = 1e-6


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def number(c: Column) -> Column:
    """The value as double, NaN as NULL: what every statistic reads."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[F.nanvl(col(c), F.lit(None)).alias(c) if c in floating else col(c) for c in df.columns]
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with neither NULL nor NaN.

    One test per column: a single test over all columns makes the optimizer's constraint
    inference grow exponentially once the columns are renamed.
    """
    keep = F.lit(True)
    for f in df.schema.fields:
        keep = keep & col(f.name).isNotNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            keep = keep & ~F.isnan(col(f.name))
    return df.where(keep)


def _total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts)


def _values(cols: Sequence[Column], clean: bool) -> list[Column]:
    """What an expression reads; ``clean`` says that the columns are doubles without NaN already.

    Wide frames normalise once and pass ``clean``: NaN guards around every use make generated
    code outgrow what the JVM compiles.
    """
    return list(cols) if clean else [number(c) for c in cols]


def row_count(cols: Sequence[Column], clean: bool = False) -> Column:
    return _total([c.isNotNull().cast("int") for c in _values(cols, clean)])


def row_mean(cols: Sequence[Column], clean: bool = False) -> Column:
    """Mean over the present values of a row."""
    total = _total([F.coalesce(c, F.lit(0.0)) for c in _values(cols, clean)])
    return F.try_divide(total, row_count(cols, clean))


def row_std(cols: Sequence[Column], mean: Column, clean: bool = False) -> Column:
    """Sample standard deviation over the present values; NULL below two values.

    ``mean`` should be a column already projected: repeating its expression per
    value makes generated code outgrow what the JVM compiles.
    """
    deviations = _total([F.coalesce(F.pow(c - mean, F.lit(2.0)), F.lit(0.0)) for c in _values(cols, clean)])
    n = row_count(cols, clean)
    return F.when(n >= 2, F.sqrt(deviations / F.nullif(n - 1, F.lit(0))))


def growth(current: Column, previous: Column, clean: bool = False) -> Column:
    """(current - previous) / previous; NULL where previous is 0 or missing."""
    current, previous = _values([current, previous], clean)
    return F.try_divide(current - previous, previous)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(number(numerator), number(denominator) + F.lit(RATIO_EPS))
