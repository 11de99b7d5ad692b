"""Strips of near queries meet boxes of near candidates, whatever cells the points come from."""

import numpy as np
import pytest

from panelforge.operators import neighbors, pairs


def wide(seed, n, dims=22, kinds=3):
    """Points whose distances come from a few directions, as those of features in different units do."""
    rng = np.random.default_rng(seed)
    x = rng.lognormal(size=(n, kinds)) @ rng.normal(size=(kinds, dims)) * 1e5 + rng.normal(size=(n, dims))
    return {"id": np.arange(n), "w": np.ones(n, dtype=np.int64), "x": x, "home": np.zeros(n, dtype=np.int64), "leaf": np.zeros(n, dtype=np.int64)}


def plain_squares(rows):
    return pairs.square_distances(rows["x"], rows["x"])


def test_queries_of_one_large_cell_meet_few_of_its_points():
    rows = wide(1, 4_000)
    radius = np.sqrt(np.partition(plain_squares(rows), 20, axis=1)[:, 20])
    met = sum(len(a) * len(b) for a, b in pairs.strips(rows, rows, pairs.Products(rows["x"], rows["x"]), radius))
    assert met < 0.25 * 4_000**2


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_within_the_radius_is_left_out(seed):
    rows = wide(seed, 700, dims=(22, 1, 3, 64)[seed], kinds=(3, 1, 3, 64)[seed])
    rows["x"][:9] = rows["x"][9]  # copies
    square = plain_squares(rows)
    for radius in (np.sqrt(np.partition(square, 5, axis=1)[:, 5]), np.full(700, np.sqrt(square[0, 1:].min())), np.full(700, np.inf)):
        met = np.zeros(square.shape, dtype=int)
        for a, b in pairs.strips(rows, rows, pairs.Products(rows["x"], rows["x"]), radius):
            met[np.ix_(a, b)] += 1
        assert met.max() == 1
        assert met[square <= (radius * radius)[:, None]].all()


def test_boxes_give_the_neighbours_of_all_pairs():
    rows = wide(7, 900)
    square = plain_squares(rows)
    np.fill_diagonal(square, np.inf)
    found = neighbors._knn_task(10)({**rows, "r": np.sqrt(np.partition(square, 9, axis=1)[:, 9])}, rows)
    got = {}
    for i, j in zip(found["id"].tolist(), found["nid"].tolist()):
        got.setdefault(i, set()).add(j)
    assert got == {i: set(np.argsort(square[i], kind="stable")[:10].tolist()) for i in range(900)}


def test_infinite_and_few_points_still_meet():
    rows = wide(3, 5)
    rows["x"][0, 0] = np.inf
    (_, candidates), = pairs.strips(rows, rows, pairs.Products(rows["x"], rows["x"]), np.ones(5))
    assert len(candidates) == 5
    none = {k: v[:0] for k, v in rows.items()}
    assert sum(len(a) * len(b) for a, b in pairs.strips(rows, none, pairs.Products(rows["x"], none["x"]), np.ones(5))) == 0
