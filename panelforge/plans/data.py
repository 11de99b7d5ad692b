"""From raw tables to the feature stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import SAMPLE_FRACTION, STAGES
from ..functions.scalars import normalize_missing
from ..operators.clean import clean_panel
from ..operators.features import build_features
from ..operators.groups import ColumnSets, column_sets
from ..operators.profile import describe, quality_report, shape_audit
from ..operators.sampling import stratified_sample
from ..session import cut_lineage
from ..sources.tables import StageStore, save_if_absent, save_parquet


@dataclass(frozen=True)
class DataResult:
    features: DataFrame
    sets: ColumnSets


def run_data_plan(
    raw: DataFrame,
    store: StageStore,
    stratum: str = "Sector 1",
    key: str = "row_id",
    fraction: float = SAMPLE_FRACTION,
) -> DataResult:
    """Sample, profile, clean, build features; writes ``quality``, ``describe``, ``sectors``, ``row_audit`` and ``raw``."""
    sample = cut_lineage(stratified_sample(normalize_missing(raw), stratum, key, fraction))
    save_if_absent(quality_report(sample), store.path("quality"))
    save_if_absent(describe(sample), store.path("describe"))
    cleaned, sectors = clean_panel(sample, order=key)
    save_parquet(sectors, store.path("sectors"))
    features = store.stage(STAGES[0], lambda: build_features(cleaned))
    save_parquet(shape_audit({"sample": sample, "cleaned": cleaned, "features": features}), store.path("row_audit"))
    return DataResult(features, column_sets(features.columns))
