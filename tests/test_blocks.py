"""Searches in blocks of leaves and distances by products, against plain versions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import buckets, concordance, dbscan, evaluate, neighbors, outliers, pairs

from .test_outliers_clusters import brute_dbscan, brute_lof


def test_a_query_is_sent_once_to_a_block(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    points = spark.createDataFrame([(i, 1, *map(float, r)) for i, r in enumerate(x)], "id long, w long, " + ", ".join(f"x{i} double" for i in range(6)))
    tree = neighbors.PivotTree(points, 6, cell_rows=8)
    assert tree.leaves.select("g").distinct().count() > 40
    queries = tree.leaves.withColumn("r", F.lit(50.0)).withColumn("home", F.col("g"))
    asked, _ = tree.descend(queries)
    assert asked.count() == 400  # not one row per leaf


def test_search_through_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(neighbors.PivotTree.__init__, "__defaults__", (neighbors.CELL_ROWS, 0, 3))
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(350, 2)), rng.normal(size=(80, 2)) * 0.05 + 4, np.tile([[1.0, 1.0]], (20, 1))]).round(4)
    pdf = pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf)
    tree = neighbors.PivotTree(neighbors.weighted_points(df, "id", ["a", "b"]), 2, cell_rows=12)
    assert tree.descents >= 2
    assert tree.leaves.select("block").distinct().count() > 4
    got = outliers.lof_scores(df, ["a", "b"], "id", 6, cell_rows=12).toPandas().sort_values("id")
    assert np.allclose(got["_lof"], brute_lof(pdf, 6), rtol=1e-9)
    labels = dbscan.dbscan(df, "id", ["a", "b"], 0.3, 5, cell_rows=12).toPandas().sort_values("id")["Cluster"]
    assert (labels.to_numpy() == brute_dbscan(pdf, 0.3, 5)).all()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_products_decide_as_differences(shift):
    rng = np.random.default_rng(5)
    # a lattice: very many pairs lie at the radius itself
    x = rng.integers(0, 4, (700, 5)) * 0.1 + shift
    x = np.vstack([x, x[:50]])
    square = pairs.square_distances(x, x)
    eps = float(np.sqrt(square[square > 0].min() * 3))
    rows = {"id": np.arange(len(x)), "w": np.ones(len(x), dtype=np.int64), "x": x, "leaf": rng.integers(0, 9, len(x)), "label": np.arange(len(x))[::-1]}
    rows["home"] = rows["leaf"]
    assert (dbscan._count_task(eps)(rows, rows)["near"] == (square <= eps * eps).sum(axis=1)).all()
    assert (dbscan._label_task(eps)(rows, rows)["label"] == np.where(square <= eps * eps, rows["label"], 9_999).min(axis=1)).all()
    places = np.arange(len(x))
    assert (pairs.pair_squares(x, x, places, places[::-1]) == square[places, places[::-1]]).all()
    far = pairs.Products(x, x).distances(slice(None), slice(None))
    assert np.allclose(far, np.sqrt(square), rtol=1e-7, atol=0)
    found = neighbors._knn_task(7)(rows, rows)
    for i in (0, 3, 749):
        order = [j for j in np.lexsort((places, square[i])) if j != i][:7]
        mine = found["id"] == i
        assert set(order) <= set(found["nid"][mine])


def test_infinite_coordinates_are_left_to_differences():
    x = np.array([[0.0, 0.0], [0.5, 0.0], [np.inf, 0.0], [1e200, 0.0]])
    rows = {"id": np.arange(4), "w": np.ones(4, dtype=np.int64), "x": x}
    assert dbscan._count_task(1.0)(rows, rows)["near"].tolist() == [2, 2, 0, 1]


def test_silhouette_sums_hold_small_matrices():
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(3_000, 8)) + 1e3, np.r_[np.arange(500), rng.integers(0, 40, 2_500)]
    rows = {"id": np.arange(len(x)), "size": np.ones(len(x), dtype=np.int64), "label": label, "x": x}
    tracemalloc.start()
    got = evaluate._own_and_nearest(rows, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # sums of 3,000 x 500 clusters, never 3,000 x 3,000 distances
    far = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(-1))
    for i in range(200):
        sums = {v: far[i, label == v] for v in np.unique(label)}
        assert np.isclose(got["own_total"][i], sums[label[i]].sum(), rtol=1e-9)
        assert np.isclose(got["other"][i], min(d.mean() for v, d in sums.items() if v != label[i]), rtol=1e-9)


def test_concordance_tasks_hold_few_columns(spark, monkeypatch):
    seen = concordance._bucket_task(40, [0.0] * 40, False)
    columns = {"x": np.arange(6.0)} | {f"y{i}": np.arange(6.0)[::-1] for i in range(16)} | {f"d{i}": np.zeros(6) for i in range(16)}
    out = seen((20, 0, 1), pd.DataFrame(columns))
    assert set(out.loc[out["kind"] == "sum", "j"]) == set(range(21, 32))  # of 40 columns
    monkeypatch.setattr(concordance, "TASK_COLUMNS", 2)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, (90, 5)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")))
    upper = np.triu_indices(90, 1)
    for rows in (1_000, 20):  # one bucket, and many with cells
        sums, ties, n = concordance.pair_sums(df, list("abcde"), rows)
        got = {(r["i"], r["j"]): (r["k"], r["d"]) for r in sums.collect()}
        assert n == 90 and len(got) == 10
        for (i, j), (k, d) in got.items():
            dx, dy = (x[:, c, None] - x[None, :, c] for c in (i, j))
            assert k == np.sign(dx * dy)[upper].sum()
            assert np.isclose(d, np.abs(dx * dy)[upper].sum())
        assert {r["c"]: r["t"] for r in ties.collect()} == {c: (x[:, c, None] == x[None, :, c])[upper].sum() for c in range(5)}


def test_small_buckets_do_not_make_thousands_of_ranges():
    assert buckets.range_count(450_000, 1_000) == 200
    assert buckets.range_count(27_000_000, 1_000) == 540
    assert buckets.range_count(45_000, 1_000) == 45 and buckets.range_count(0, 1_000) == 1
    assert buckets.range_count(10**10, 250_000) == 10_000
