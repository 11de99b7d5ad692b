"""Cleaning, encoding and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import COUNTRY_CODES, RATING_CODES, YEARS
from ..functions.scalars import col, normalize_missing, number
from ..session import cut_lineage, is_small

SINGLE_TASK_CATEGORIES = 1_000_000


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in names])


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with no NULL or NaN in ``cols`` (default all)."""
    df = normalize_missing(df)
    keep = F.lit(True)
    for c in cols or df.columns:
        keep = keep & col(c).isNotNull()
    return df.where(keep)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in ``order``: a combining aggregate, so a hot key is no hot task."""
    row = F.struct(*[col(c) for c in df.columns])
    first = df.groupBy(col(key).alias("_key")).agg(F.min_by(row, col(order)).alias("_row"))
    return first.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def map_values(df: DataFrame, maps: Mapping[str, Mapping], unmapped: str = "error") -> DataFrame:
    """Replace categories by codes, one map per column.

    A value outside its map raises with ``unmapped='error'`` and becomes NULL with ``'null'``.
    """
    if unmapped not in ("error", "null"):
        raise ValueError("unmapped must be 'error' or 'null'")
    absent = [c for c in maps if c not in df.columns]
    if absent:
        raise KeyError(f"columns not in frame: {absent}")

    def code(name: str) -> Column:
        found = F.try_element_at(_lookup(maps[name]), col(name))
        if unmapped == "null":
            return found
        message = F.concat(F.lit(f"no code for {name}: "), col(name).cast("string"))
        return F.when(found.isNotNull() | col(name).isNull(), found).otherwise(F.raise_error(message).cast("int"))

    return df.select(*[code(c).alias(c) if c in maps else col(c) for c in df.columns])


def rating_maps(years: Sequence[str] = YEARS) -> dict[str, Mapping]:
    return {"Country": COUNTRY_CODES, **{f"MScore.{y}": RATING_CODES for y in years}}


def composite_key(df: DataFrame, out: str, parts: Sequence[str], sep: str = "_") -> DataFrame:
    """Join columns into one key; NULL when any part is."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        pieces += [F.lit(sep), col(p)] if i else [col(p)]
    return df.withColumn(out, F.concat(*pieces))


def category_codes(df: DataFrame, name: str, small: int = SINGLE_TASK_CATEGORIES) -> DataFrame:
    """Dimension table (category, code): sorted distinct values numbered from 0."""
    return _codes(df, name, small)[0]


def _codes(df: DataFrame, name: str, small: int) -> tuple[DataFrame, bool]:
    """The dimension table and whether it was found to be small."""
    distinct = cut_lineage(df.where(col(name).isNotNull()).select(col(name).alias("category")).distinct())
    if is_small(distinct, small):
        order = Window.partitionBy(F.lit(0)).orderBy("category")
        return distinct.select("category", (F.row_number().over(order) - 1).cast("long").alias("code")), True
    ranged = distinct.repartitionByRange("category").withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the range shuffle
    offsets = parts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy("category")
    codes = (
        ranged.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .select("category", (F.col("_offset") + F.col("_rank") - 1).alias("code"))
    )
    return codes, False


def label_encode(df: DataFrame, name: str, small: int = SINGLE_TASK_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Replace a category by its code; also returns the dimension table.

    A dimension too large to broadcast is joined by shuffle, where adaptive execution
    splits a category that fills much of the data.
    """
    codes, bounded = _codes(df, name, small)
    side = codes.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    joined = df.join(F.broadcast(side) if bounded else side, col(name) == F.col("_category"), "left")
    return joined.select(*[F.col("_code").alias(c) if c == name else col(c) for c in df.columns]), codes


def scale_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """(mean, population standard deviation) per column; a constant column scales by 1."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(number(col(c))).alias(f"m{i}"), F.stddev_pop(number(col(c))).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    moments = scale_moments(df, cols)

    def scaled(c: str) -> Column:
        mean, std = moments[c]
        if mean is None:
            return col(c)
        return ((number(col(c)) - F.lit(mean)) / F.lit(std)).alias(c)

    return df.select(*[scaled(c) if c in moments else col(c) for c in df.columns])


def replace_values(df: DataFrame, name: str, mapping: Mapping) -> DataFrame:
    """All replacements at once; values outside the map stay."""
    return df.withColumn(name, F.coalesce(F.try_element_at(_lookup(mapping), col(name)), col(name)))


def remove_rows(df: DataFrame, key: str = "Company name", order: str = "row_id", drop: Sequence[str] = ("No",)) -> DataFrame:
    """Drop the number column, incomplete rows, then repeated keys."""
    return keep_first(drop_missing(drop_if_present(df, *drop)), key, order)


def clean_panel(df: DataFrame, order: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Cleaned and encoded panel with the sector dimension table.

    The kept rows are stored once: encoding and every later step read them more than once.
    """
    rows = cut_lineage(remove_rows(df, order=order))
    keyed = composite_key(map_values(rows, rating_maps()), "Combined_Sector", ["Sector 2", "Sector 1"])
    return label_encode(keyed, "Combined_Sector")
