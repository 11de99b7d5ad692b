"""Neighbour searches: bounds of small leaves come from a larger cell, and few pairs are kept on the way."""

import numpy as np
import pytest

from panelforge.operators import neighbors, pairs


def test_small_leaves_bound_their_queries_by_a_larger_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(300, 6)), 5
    fields = ", ".join(f"x{i} double" for i in range(6))
    points = spark.createDataFrame([(i, 1, *map(float, x[i])) for i in range(300)], f"id long, w long, {fields}")
    asked, compare = [], neighbors.compare

    def seen(queries, *args):
        asked.append(queries)
        return compare(queries, *args)

    monkeypatch.setattr(neighbors, "compare", seen)
    found = neighbors.nearest_neighbors(points, 6, k, cell_rows=10)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    kth = np.sort(apart, axis=1)[:, k]
    radius = {r["id"]: r["r"] for r in asked[-1].select("id", "r").distinct().collect()}
    # all points are one cell of at most CELL_ROWS; leaves of 10 bound by more than that
    np.testing.assert_allclose([radius[i] for i in range(300)], kth, rtol=1e-6)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["nid"])
    assert got == {i: set(np.argsort(apart[i], kind="stable")[1 : k + 1].tolist()) for i in range(300)}


def test_many_points_have_larger_blocks(spark, monkeypatch):
    fields = "id long, w long, x0 double"
    points = spark.createDataFrame([(i, 1, float(i * 37 % 100)) for i in range(100)], fields)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 10)
    blocks = []
    for moved in (10**6, 100):
        monkeypatch.setattr(neighbors, "MOVED_ROWS", moved)
        tree = neighbors.PivotTree(points, 1, 5, fan=4)
        blocks.append(tree.leaves.select("block").distinct().count())
        assert tree.leaves.count() == 100
    assert blocks[1] < blocks[0]


@pytest.mark.parametrize("seed", range(6))
def test_the_least_places_are_all_there_and_few_others(monkeypatch, seed):
    monkeypatch.setattr(pairs, "TILE_COLUMNS", 40)
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(30, 3)) + 1e4 * (seed == 5)
    b = rng.integers(0, 3, (400, 3)).astype(float) if seed == 4 else rng.normal(size=(400, 3)) + 1e4 * (seed == 5)
    limit = np.full(30, np.inf) if seed % 2 else rng.exponential(1.0, 30)
    rows, columns = np.arange(30), rng.permutation(400) if seed > 2 else np.arange(400)
    i, j = pairs.least_places(rows, columns, pairs.Products(a, b), 4, limit)
    square = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    for row in range(30):
        met = set(j[i == row].tolist())
        last = min(np.sort(square[row])[4], limit[row])
        assert set(np.flatnonzero(square[row] <= last).tolist()) <= met
        assert (square[row, list(met)] <= last + 1e-6).all()
