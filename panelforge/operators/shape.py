"""Skewness and kurtosis under candidate transforms; choosing and applying the best."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, finite
from ..functions.shape import POLE_EPS, TransformRegistry
from ..session import spread
from .clean import drop_missing, standard_scale
from .power import fit_power
from .quantiles import long_form
from .sampling import stratified_sample

log = logging.getLogger(__name__)

IDENTITY = "identity"


def _rounded(c: Column, digits: int = 2) -> Column:
    return F.bround(finite(c), digits) + F.lit(0.0)


def moments(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Population skewness and excess kurtosis per column: (column, skew, kurt)."""
    skew, kurt = F.skewness("value"), F.kurtosis("value")
    if digits is not None:
        skew, kurt = _rounded(skew, digits), _rounded(kurt, digits)
    return long_form(df, cols).groupBy("column").agg(skew.alias("skew"), kurt.alias("kurt"))


def shape_report(
    df: DataFrame,
    cols: Sequence[str],
    lambdas: Mapping[str, float] | None = None,
    registry: TransformRegistry | None = None,
) -> DataFrame:
    """(column, transform, skew_before, skew_after, kurt_before, kurt_after), two decimals.

    All columns and transforms share one scan and one aggregate keyed by column.
    """
    registry = registry or TransformRegistry()
    names = [t for t in registry.names() if lambdas or not registry.needs_fit(t)]
    value = F.col("value")
    lam = None
    if lambdas:
        table = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(lambdas[c])))])
        lam = table[F.col("column")]
    at_pole = value + F.lit(POLE_EPS) == 0
    versions = [F.struct(F.lit(IDENTITY).alias("transform"), value.alias("y"), F.lit(False).alias("pole"))]
    for t in names:
        pole = at_pole if registry.has_pole(t) else F.lit(False)
        versions.append(F.struct(F.lit(t).alias("transform"), registry.build(t, value, lam).alias("y"), pole.alias("pole")))
    # one small aggregate over (column, transform) rows: generated code stays within JIT limits
    rows = long_form(spread(df), cols).select("column", F.inline(F.array(*versions)))
    y = finite(F.col("y"))
    measured = (
        rows.select("column", "transform", y.alias("y"), "pole")
        .groupBy("column", "transform")
        .agg(F.skewness("y").alias("s"), F.kurtosis("y").alias("k"), F.count_if(F.col("pole")).alias("poles"))
    )
    usable = F.col("poles") == 0
    per_column = measured.groupBy("column").agg(
        F.max(F.when(F.col("transform") == IDENTITY, F.col("s"))).alias("s0"),
        F.max(F.when(F.col("transform") == IDENTITY, F.col("k"))).alias("k0"),
        F.collect_list(
            F.struct("transform", F.when(usable, F.col("s")).alias("s"), F.when(usable, F.col("k")).alias("k"))
        ).alias("after"),  # one entry per transform
    )
    return (
        per_column.select("column", "s0", "k0", F.inline("after"))
        .where(F.col("transform") != IDENTITY)
        .select(
            "column",
            "transform",
            _rounded(F.col("s0")).alias("skew_before"),
            _rounded(F.col("s")).alias("skew_after"),
            _rounded(F.col("k0")).alias("kurt_before"),
            _rounded(F.col("k")).alias("kurt_after"),
        )
    )


def analyze_shape(
    df: DataFrame,
    cols: Sequence[str],
    stratum: str,
    key: str,
    fraction: float,
    registry: TransformRegistry | None = None,
) -> DataFrame:
    """Shape report on a stratified sample, power fitted on that sample."""
    registry = registry or TransformRegistry()
    sample = stratified_sample(df, stratum, key, fraction)
    fitted = any(registry.needs_fit(t) for t in registry.names())
    return shape_report(sample, cols, fit_power(sample, cols) if fitted else None, registry)


def transform_table(report: DataFrame) -> DataFrame:
    """(column, transform, skew, kurt) of the transformed values."""
    return report.select("column", "transform", F.col("skew_after").alias("skew"), F.col("kurt_after").alias("kurt"))


def optimal_transforms(table: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Lowest |skew| + |kurt| per column, the earlier transform on a tie.

    A column with no usable measure gets ``identity``.
    """
    order = list(order or TransformRegistry().names())
    metric = F.abs("skew") + F.abs("kurt")
    position = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("transform"))
    rank = F.when(metric.isNotNull(), F.struct(metric.alias("m"), position.alias("p")))
    best = table.groupBy("column").agg(F.min_by(F.struct("transform", "skew", "kurt"), rank).alias("best"))
    return best.select(
        "column",
        F.coalesce(F.col("best.transform"), F.lit(IDENTITY)).alias("transform"),
        F.col("best.skew").alias("skew"),
        F.col("best.kurt").alias("kurt"),
    )


def above_threshold(chosen: DataFrame, threshold: float) -> DataFrame:
    """Chosen transforms whose mean of |skew| and |kurt| reaches the threshold."""
    return chosen.where((F.abs("skew") + F.abs("kurt")) / 2 >= F.lit(float(threshold)))


def reshape_columns(
    df: DataFrame, chosen: Mapping[str, str], registry: TransformRegistry | None = None
) -> DataFrame:
    """Apply a transform per column in one projection; power is fitted on this frame."""
    registry = registry or TransformRegistry()
    available = set(registry.names())
    known = {c: t for c, t in chosen.items() if t in available}
    if unknown := sorted(set(chosen.values()) - available):
        log.warning("the registry has no %s; those columns stay as they are", ", ".join(unknown))
    if not known:
        return df
    power = [c for c, t in known.items() if registry.needs_fit(t)]
    lambdas = fit_power(df, power) if power else {}

    def shaped(c: str) -> Column:
        if c not in known:
            return col(c)
        lam = F.lit(lambdas[c]) if c in lambdas else None
        return finite(registry.build(known[c], col(c).cast("double"), lam)).alias(c)

    out = df.select(*[shaped(c) for c in df.columns])
    return standard_scale(out, power) if power else out


def choose_and_apply(
    df: DataFrame, table: DataFrame, threshold: float = 0.0, registry: TransformRegistry | None = None
) -> tuple[DataFrame, DataFrame]:
    """One round: pick per column, filter by threshold, apply. Returns (frame, chosen)."""
    registry = registry or TransformRegistry()
    chosen = above_threshold(optimal_transforms(table, registry.names()), threshold)
    picks = {r["column"]: r["transform"] for r in chosen.collect()}
    return reshape_columns(df, {c: picks[c] for c in df.columns if c in picks}, registry), chosen


def mean_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean skewness and kurtosis over the columns, complete rows only, two decimals."""
    per_column = moments(drop_missing(df.select(*[col(c) for c in cols])), cols)
    return per_column.agg(_rounded(F.avg("skew")).alias("mean_skew"), _rounded(F.avg("kurt")).alias("mean_kurt"))


def shape_audit(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean_shape before and after a transform round."""
    return (
        mean_shape(before, cols)
        .select(F.lit("before").alias("phase"), "*")
        .unionAll(mean_shape(after, cols).select(F.lit("after").alias("phase"), "*"))
    )
