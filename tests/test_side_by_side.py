"""Steps that do not need each other run at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from panelforge import catalog
from panelforge.catalog import modelling
from panelforge.config import Density, ModelSettings, Partition
from panelforge.plans import model, stats
from panelforge.session import side_by_side
from panelforge.sources.tables import StageStore


@pytest.fixture
def meeting(monkeypatch):
    """Every clustering waits until all three have begun."""
    here, plain = threading.Barrier(3, timeout=60), modelling.cluster.cluster

    def waits(*args, **params):
        here.wait()
        return plain(*args, **params)

    monkeypatch.setattr(modelling.cluster, "cluster", waits)
    monkeypatch.setattr(model, "cluster", waits)


def rows(spark):
    return spark.createDataFrame([(i, [float(i % 3) * 10 + (i // 3 % 4 + j % 5) / 10 for j in range(64)], i % 3) for i in range(24)], "vec_id long, embedding array<double>, label int")


def test_the_three_clusterings_of_m8_run_together(spark, meeting, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.queries()["m8_cluster_by_method_embeddings"](spark, str(tmp_path)).collect()
    assert sorted((r["method"], r["vec_id"]) for r in found) == sorted((m, i) for m in ("kmeans", "dbscan", "agglomerative") for i in range(24))


def test_the_comparison_runs_its_methods_together_and_reports_in_their_order(spark, meeting):
    df = rows(spark).selectExpr("vec_id", "embedding[0] as a", "embedding[4] as b")
    settings = ModelSettings(density=Density(radius=1.0), partition=Partition(clusters=3))
    labelled, report = model.compare_methods(df, ["a", "b"], "vec_id", settings)
    assert list(labelled) == list(settings.methods)
    assert sorted(r["method"] for r in report.collect()) == sorted(settings.methods)


def test_results_keep_their_order_and_errors_are_raised(spark):
    assert side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(4)]) == [0, 1, 2, 3]
    assert side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 / 0])


def test_stages_are_explored_together(spark, monkeypatch, tmp_path):
    here = threading.Barrier(2, timeout=60)

    def meets(df, cols, key, run):
        here.wait()
        return df.select(F.lit(run).alias("run"), F.col("a").alias("value")), None

    monkeypatch.setattr(stats, "explore", meets)
    store = StageStore(spark, str(tmp_path), "together")
    for i, name in enumerate(("raw", "outliers")):
        store.save(spark.createDataFrame([(j, "s", float(i + j)) for j in range(4)], "row_id long, kind string, a double"), name)
    found = stats.explore_stages(store, ["raw", "outliers"], ["a"], "kind", "row_id", 1.0, plots=False)
    assert sorted((r["run"], r["value"]) for r in found.collect()) == [(i, float(i + j)) for i in range(2) for j in range(4)]
