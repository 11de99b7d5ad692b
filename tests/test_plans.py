"""The composed runs on the smallest tables, and a run that is interrupted and goes on."""

import pytest

from panelforge.config import ModelSettings, StudySettings
from panelforge.operators import density
from panelforge.plans.data import run_data_plan
from panelforge.plans.model import run_model_plan
from panelforge.plans.stats import run_stats_plan
from panelforge.sources.panel import company_panel
from panelforge.sources.tables import StageStore

SETTINGS = StudySettings(fraction=1.0)


@pytest.fixture(scope="module")
def root(spark, small_dir, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("stages"))
    run_data_plan(company_panel(spark, small_dir), StageStore(spark, place, "one"), fraction=1.0)
    return place


def test_stages_resume_after_the_last_finished_one(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    first = StageStore(spark, str(tmp_path), "r")
    first.stage("a", lambda: build(1))
    first.stage("b", lambda: build(2))
    with pytest.raises(ZeroDivisionError):
        first.stage("c", lambda: build(1 // 0))
    again = StageStore(spark, str(tmp_path), "r", resume=True)
    assert again.finished("a") and not again.finished("c")
    assert [again.stage(n, lambda n=n: build(ord(n))).count() for n in "abcd"] == [1, 2, 99, 100]
    assert calls == [1, 2, 99, 100]
    # once a stage is built, later ones are too, finished or not
    later = StageStore(spark, str(tmp_path), "r", resume=True)
    later.stage("new", lambda: build(5))
    later.stage("a", lambda: build(6))
    assert calls[-2:] == [5, 6]
    # without resume everything is built
    StageStore(spark, str(tmp_path), "r").stage("a", lambda: build(7))
    assert calls[-1] == 7


def test_an_interrupted_stats_run_goes_on(spark, root, monkeypatch):
    curve = density.density_curve
    seen = []

    def broken(*args):
        seen.append(args)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return curve(*args)

    monkeypatch.setattr(density, "density_curve", broken)
    with pytest.raises(RuntimeError):
        run_stats_plan(StageStore(spark, root, "one"), SETTINGS)
    monkeypatch.setattr(density, "density_curve", curve)
    kept = StageStore(spark, root, "one")
    before = {n: spark.read.parquet(kept.path(n)).inputFiles() for n in ("outliers", "transform2", "matrices0")}
    assert all(kept.finished(n) for n in before) and not kept.finished("eigenvalues")
    shaped = run_stats_plan(StageStore(spark, root, "one", resume=True), SETTINGS)
    after = {n: spark.read.parquet(kept.path(n)).inputFiles() for n in before}
    assert {n: sorted(f) for n, f in after.items()} == {n: sorted(f) for n, f in before.items()}
    raw, clean = kept.load("raw"), kept.load("outliers")
    assert 0 < shaped.count() == clean.count() <= raw.count()
    methods = {r["method"] for r in kept.load("matrices3").select("method").distinct().collect()}
    assert methods == {"pearson", "spearman", "kendall", "distance"}
    assert kept.load("matrices1").count() == 4 * 19 * 19
    spectra = kept.load("eigenvalues").groupBy("run").sum("eigenvalue").collect()
    assert {r["run"] for r in spectra} == {1, 2, 3}
    assert all(abs(r["sum(eigenvalue)"] - 19) < 1e-3 for r in spectra)  # the trace


def test_model_run_reports_every_method(spark, root):
    store = StageStore(spark, root, "one")
    if not store.finished("transform2"):
        run_stats_plan(StageStore(spark, root, "one", resume=True), SETTINGS)
    report = run_model_plan(store, ModelSettings(), manifest=f"{root}/manifest").collect()
    assert sorted(r["method"] for r in report) == ["agglomerative", "dbscan", "kmeans"]
    n = store.load("transform2").count()
    for method in ("kmeans", "agglomerative"):
        assert store.load(f"sizes_{method}").groupBy().sum("count").first()[0] == n
        found = next(r for r in report if r["method"] == method)
        assert -1 <= found["silhouette"] <= 1 and found["davies_bouldin"] >= 0
    assert 0 <= store.load("match_rate").first()[0] <= 100
    assert store.load("components").count() == 3
    assert spark.read.parquet(f"{root}/manifest").select("stage", "status").collect() == [("model", "done")]
