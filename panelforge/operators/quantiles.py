"""Exact linear-interpolation quantiles without gathering a column in one task.

A sketch brackets every wanted rank; only the distinct values inside the brackets (about
6/accuracy of the rows) are shuffled, counted and ranked. Where that may still be more than
``window_rows`` values of a group, another sketch of the bracket's inside narrows it, again and
again. Groups with at most ``accuracy`` values are ranked whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col, number
from ..session import broadcast_if_small, store

ACCURACY = 10_000
#: Distinct values of a group that are ordered in one window.
WINDOW_ROWS = 100_000
#: Points of the sketch of a bracket's inside; a narrower bracket spans a few of them.
GRID = 1_000


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """(keep..., column, value) rows of the given columns, all cast to one type; NaN becomes NULL."""
    typed = (lambda c: number(col(c))) if dtype == "double" else (lambda c: col(c).cast(dtype))
    cast = df.select(*[col(k) for k in keep], *[typed(c).alias(c) for c in cols])
    return cast.unpivot([col(k) for k in keep], [col(c) for c in cols], "column", "value")


def grouped_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Exact quantiles per key group: (keys..., prob, quantile)."""
    names = [f"_key{i}" for i in range(len(keys))]
    present = long.where(col(value).isNotNull()).select(*[col(k).alias(n) for k, n in zip(keys, names)], col(value).alias("_v"))
    brackets = _brackets(present, names, [float(p) for p in probs], accuracy, window_rows)
    marked = _inside(present, brackets, names)
    counted = marked.groupBy(*names, "prob", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    window = Window.partitionBy(*names, "prob").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = (F.col("_n") - 1) * F.col("prob")
    first = F.floor(position)
    picked = counted.withColumn("_upto", upto).groupBy(*names, "prob").agg(
        F.max(position - first).alias("_frac"),
        F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > first + 1, F.col("_v"))).alias("_b"),
    )
    a, b = F.col("_a"), F.coalesce("_b", "_a")
    return picked.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "prob", (a + (b - a) * F.col("_frac")).alias("quantile"))


def _inside(present: DataFrame, brackets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values up to the end of their group's brackets: (names..., _v, prob, _n, _lo, _hi)."""
    listed = brackets.groupBy(*names).agg(F.collect_list(F.struct("prob", "_n", "_lo", "_hi")).alias("_brackets"))  # as many as probs
    side = listed.select(*[F.col(n).alias(f"_on{n}") for n in names], "_brackets")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_on{n}"))
    joined = present.join(broadcast_if_small(side), same)
    return joined.select(*names, "_v", F.inline("_brackets")).where(F.col("_v") <= F.col("_hi"))


def _brackets(present: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int, window_rows: int) -> DataFrame:
    """(names..., prob, _n, _lo, _hi): ends between which the wanted ranks lie, with at most ``window_rows`` values inside."""
    margin = 3.0 / accuracy
    lows = [max(0.0, p - margin) for p in probs]
    highs = [min(1.0, p + margin) for p in probs]
    stats = present.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", [*lows, *highs], accuracy).alias("_sketch")
    )
    whole = F.col("_n") <= accuracy
    # a bracket spans two margins and what the sketch may be off at either end
    most = F.when(whole, F.col("_n")).otherwise(F.ceil(F.col("_n") * (2 * margin + 2.0 / accuracy)) + 2)
    ends = [
        F.struct(
            F.lit(p).alias("prob"),
            F.col("_n").alias("_n"),
            F.when(whole, F.col("_min")).otherwise(F.col("_sketch")[i]).alias("_lo"),
            F.when(whole, F.col("_max")).otherwise(F.col("_sketch")[i + len(probs)]).alias("_hi"),
            most.alias("_most"),
        )
        for i, p in enumerate(probs)
    ]
    brackets = store(stats.select(*names, F.inline(F.array(*ends))))
    while not brackets.where((F.col("_most") > window_rows) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        brackets = store(_narrowed(present, brackets, names, accuracy, window_rows))
    return brackets.drop("_most")


def _narrowed(present: DataFrame, brackets: DataFrame, names: Sequence[str], accuracy: int, window_rows: int) -> DataFrame:
    """Brackets that may hold too many values, cut down to a few points of a sketch of their inside."""
    wide = (F.col("_most") > window_rows) & (F.col("_lo") < F.col("_hi"))
    marked = _inside(present, brackets.where(wide), names)
    within = (F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi"))
    grid = [i / GRID for i in range(GRID + 1)]
    found = marked.groupBy(*names, "prob", "_n", "_lo", "_hi").agg(
        F.count_if(F.col("_v") <= F.col("_lo")).alias("_before"),
        F.count_if(within).alias("_m"),
        F.percentile_approx(F.when(within, F.col("_v")), grid, max(accuracy, 10 * GRID)).alias("_points"),
    )
    # places of the two wanted ranks among the values inside, as points of the grid
    rank = F.floor((F.col("_n") - 1) * F.col("prob")) - F.col("_before")
    share = lambda k: k * GRID / F.greatest(F.col("_m"), F.lit(1))
    low, high = F.floor(share(rank)) - 2, F.ceil(share(rank + 2)) + 2
    # a rank at an end of the bracket, or nothing inside, keeps that end
    lo = F.when((low < 0) | (F.col("_m") == 0), F.col("_lo")).otherwise(F.element_at("_points", F.greatest(F.least(low, F.lit(GRID)), F.lit(0)).cast("int") + 1))
    hi = F.when((high > GRID) | (F.col("_m") == 0), F.col("_hi")).otherwise(F.element_at("_points", F.least(F.greatest(high, F.lit(0)), F.lit(GRID)).cast("int") + 1))
    most = F.ceil(F.col("_m") * (8.0 / GRID)) + 2
    narrow = found.select(*names, "prob", "_n", lo.alias("_lo"), hi.alias("_hi"), F.when(F.col("_m") <= window_rows, F.least(F.col("_m") + 2, F.lit(window_rows))).otherwise(most).alias("_most"))
    return narrow.unionAll(brackets.where(~wide).select(narrow.columns))


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Exact quantiles of each column as plain numbers (columns x probs of them)."""
    rows = grouped_quantiles(long_form(df, cols), ["column"], "value", probs, accuracy).collect()
    found = {(r["column"], r["prob"]): r["quantile"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in cols}
