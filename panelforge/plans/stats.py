"""Outliers, shape rounds, exploration and matrix studies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STAGES, StudySettings
from ..functions.scalars import col
from ..operators import density, matrices
from ..operators.concordance import pair_sums
from ..operators.correlation import distance_correlation, kendall, pearson, spearman, variance_vector
from ..operators.groups import column_sets, without
from ..operators.outliers import outlier_chain
from ..operators.sampling import stratified_sample
from ..operators.shape import analyze_shape, choose_and_apply, shape_audit
from ..session import side_by_side
from ..sources.tables import StageStore, append_manifest

METHODS = ("pearson", "spearman", "kendall", "distance")


def explore(df: DataFrame, cols: Sequence[str], key: str, run: int) -> tuple[DataFrame, DataFrame]:
    """(matrices, variances) of one stage with its run number: all four correlation methods."""
    # one comparison of all row pairs serves both measures
    sums = pair_sums(df, cols)
    found = {
        "pearson": pearson(df, cols),
        "spearman": spearman(df, cols, key),
        "kendall": kendall(df, cols, found=sums),
        "distance": distance_correlation(df, cols, key, found=sums),
    }
    parts = [m.select(F.lit(run).alias("run"), F.lit(name).alias("method"), "*") for name, m in found.items()]
    return reduce(DataFrame.unionAll, parts), run_variances(df, cols, run)


def run_variances(df: DataFrame, cols: Sequence[str], run: int) -> DataFrame:
    return variance_vector(df, cols).select(F.lit(run).alias("run"), "*")


def shape_rounds(
    df: DataFrame, cols: Sequence[str], stratum: str, key: str, settings: StudySettings, store: StageStore
) -> DataFrame:
    """Analyse, choose and apply transforms ``rounds`` times, storing stage and map of each."""
    for i in range(1, settings.shapes.rounds + 1):
        before = df
        report = store.stage(f"shape{i}", lambda: analyze_shape(before, cols, stratum, key, settings.fraction))
        table = report.select("column", "transform", F.col("skew_after").alias("skew"), F.col("kurt_after").alias("kurt"))
        shaped, chosen = choose_and_apply(df, table, settings.shapes.least)
        store.stage(f"transform_map{i}", lambda: chosen)
        df = store.stage(f"transform{i}", lambda: shaped)
        store.stage(f"shape_audit{i}", lambda: shape_audit(before, df, cols))
    return df


def explore_stages(
    store: StageStore, stages: Sequence[str], cols: Sequence[str], stratum: str, key: str, fraction: float, plots: bool = True
) -> DataFrame:
    """Exploration of every stored stage on its stratified sample, plot tables unless told not to; returns the stored matrices."""

    def one(run: int, stage: str) -> None:
        sample = store.stage(f"sample{run}", lambda: stratified_sample(store.load(stage), stratum, key, fraction))
        store.stage(f"matrices{run}", lambda: explore(sample, cols, key, run)[0])
        store.stage(f"variances{run}", lambda: run_variances(sample, cols, run))
        for group, names in column_sets(sample.columns).sets.items():
            if plots and group in ("grow", "raw_mean", "fur"):
                store.stage(f"density_{group}{run}", lambda: density.density_curve(sample, names))
                store.stage(f"pairs_{group}{run}", lambda: density.scatter_pairs(sample, names, stratum, key, 1.0))

    # stages are stored already, and none reads what another's exploration wrote
    side_by_side(store.spark, [lambda run=run, stage=stage: one(run, stage) for run, stage in enumerate(stages)])
    return reduce(DataFrame.unionAll, [store.load(f"matrices{run}") for run in range(len(stages))])


def matrix_studies(found: DataFrame, cols: Sequence[str], runs: Sequence[int], store: StageStore) -> None:
    """Norms, their differences and eigenvalues of the distance matrices."""
    distance = found.where((F.col("method") == "distance") & F.col("run").isin(list(runs)))
    norms = store.stage("norms", lambda: matrices.matrix_norms(distance, ["run"]))
    store.stage("norm_differences", lambda: matrices.run_differences(norms))

    def spectrum(run: int) -> DataFrame:
        values = matrices.variance_explained(matrices.eigenvalues(distance.where(F.col("run") == run), cols))
        return values.select(F.lit(run).alias("run"), "*")

    store.stage("eigenvalues", lambda: reduce(DataFrame.unionAll, [spectrum(run) for run in runs]))


def run_stats_plan(
    store: StageStore,
    settings: StudySettings | None = None,
    stratum: str = "Sector 1",
    key: str = "row_id",
    manifest: str | None = None,
    run_id: str = "run",
) -> DataFrame:
    """All steps after the feature stage; the manifest row is written even on failure.

    With a resuming store, an interrupted run goes on after its last finished stage.
    """
    settings = settings or StudySettings()
    status = "failed"
    try:
        raw = store.load(STAGES[0])
        sets = column_sets(raw.columns)
        kept = store.stage(STAGES[1], lambda: outlier_chain(raw, sets["continuous"], key, settings))
        shaped = shape_rounds(kept, sets["continuous"], stratum, key, settings, store)
        stages = [*STAGES[:2], *[f"transform{i}" for i in range(1, settings.shapes.rounds + 1)]]
        cols = without(sets["all"], sets["vol"])
        found = explore_stages(store, stages, cols, stratum, key, settings.fraction)
        matrix_studies(found, cols, range(1, len(stages)), store)
        status = "done"
        return shaped.select(*[col(c) for c in shaped.columns])
    finally:
        if manifest:
            append_manifest(store.spark, manifest, run_id, "stats", status, asdict(settings))
