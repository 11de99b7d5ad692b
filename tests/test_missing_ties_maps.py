"""Missing values, NULL groups, ties, label maps and explicit choices of algorithm."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.scalars import row_mean, row_std
from panelforge.config import ModelSettings
from panelforge.operators import clean, cluster, evaluate, forest, neighbors, outliers, shape

NAN = float("nan")


@pytest.fixture(scope="module")
def holed(spark):
    """Twenty ordinary values, an outlier, a NaN and a NULL in the same column."""
    values = [float(i % 5) for i in range(20)] + [500.0, NAN, None]
    return spark.createDataFrame([(i, v, None if i < 12 else "b") for i, v in enumerate(values)], "id long, v double, g string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_missing_values_never_drop_rows(holed):
    want = [i for i in range(23) if i != 20]
    assert ids(outliers.zscore_filter(holed, ["v"], 3.0)) == want
    assert ids(outliers.iqr_filter(holed, ["v"], 1.0, (0.1, 0.9))) == want
    # 500 lies in group b; the NULL group is a group of its own
    assert ids(outliers.zscore_filter(holed, ["v"], 2.0, ["g"])) == want
    assert ids(outliers.iqr_filter(holed, ["v"], 1.0, (0.1, 0.8), ["g"])) == want


def test_fences_of_a_null_group_filter_it(spark):
    rows = [(i, float(i % 5), None) for i in range(20)] + [(20, 500.0, None), (21, 1.0, "b"), (22, NAN, "b")]
    df = spark.createDataFrame(rows, "id long, v double, g string")
    assert 20 not in ids(outliers.iqr_filter(df, ["v"], 1.0, (0.1, 0.9), ["g"]))
    assert 20 not in ids(outliers.zscore_filter(df, ["v"], 3.0, ["g"]))


def test_statistics_skip_nan(spark, holed):
    rest = holed.where("id < 21")
    for df in (clean.standard_scale(holed, ["v"]).where("id < 21"), clean.standard_scale(rest, ["v"])):
        assert df.agg(F.round(F.avg("v"), 9)).first()[0] == 0.0
    assert clean.standard_scale(holed, ["v"]).where(F.isnan("v")).count() == 0
    assert shape.moments(holed, ["v"], 6).first() == shape.moments(rest, ["v"], 6).first()
    row = spark.createDataFrame([(1.0, NAN, 3.0, None)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    got = row.withColumn("m", row_mean(cols)).select("m", row_std(cols, F.col("m")).alias("s")).first()
    assert got["m"] == 2.0 and round(got["s"], 9) == round(2.0**0.5, 9)


def test_coincident_centres_give_no_infinity(spark):
    rows = [(0, 1.0, 0), (1, -1.0, 0), (2, 2.0, 1), (3, -2.0, 1), (4, 10.0, 2), (5, 12.0, 2)]
    df = spark.createDataFrame(rows, "id long, x double, l long")
    # the ratios of the coinciding pair are left out: worst are (1 + 1) / 11, (2 + 1) / 11, (2 + 1) / 11
    assert evaluate.davies_bouldin(df, ["x"], "l", "id").first()[0] == pytest.approx(8 / 33)
    same = evaluate.davies_bouldin(df.where("l < 2"), ["x"], "l", "id").first()[0]
    assert same == 0.0


def test_tied_neighbours_are_bounded_and_chosen_by_id(spark):
    rows = [(i, *[float(i >> b & 1) for b in range(7)]) for i in range(128)]
    xs = [f"x{b}" for b in range(7)]
    df = spark.createDataFrame(rows, ["id", *xs])
    points = neighbors.weighted_points(df, "id", xs)
    task = neighbors._knn_task(5)
    p = points.orderBy("id").toPandas()
    block = {"id": p["id"].to_numpy(), "w": p["w"].to_numpy(), "x": p[xs].to_numpy()}
    assert np.bincount(task(block, block)["id"]).max() <= 6
    got = neighbors.nearest_neighbors(points, 7, 5, cell_rows=40)
    near = {}
    for r in got.collect():
        near.setdefault(r["id"], []).append(r["nid"])
    for i, found in near.items():
        order = sorted((j for j in range(128) if j != i), key=lambda j: (bin(i ^ j).count("1"), j))
        assert sorted(found) == sorted(order[:5])


def test_label_map_is_optimal_for_any_number_of_classes():
    rng = np.random.default_rng(0)
    for shape_ in ((5, 5), (4, 6), (6, 4), (1, 3)):
        for _ in range(20):
            gain = rng.integers(0, 9, shape_).astype(float)
            chosen = evaluate.assign_largest(gain)
            used = chosen[chosen >= 0]
            assert len(set(used.tolist())) == len(used)
            mine = sum(gain[i, c] for i, c in enumerate(chosen) if c >= 0)
            wide = gain if shape_[0] <= shape_[1] else gain.T
            best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
            assert mine == best
    big = np.eye(60)[np.random.default_rng(1).permutation(60)]
    assert big[np.arange(60), evaluate.assign_largest(big)].sum() == 60


def test_ward_is_never_chosen_by_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(30)], "id long, a double, b double")
    monkeypatch.setattr(cluster, "EXACT_POINTS", 20)
    with pytest.raises(ValueError):
        cluster.agglomerative(df, ["a", "b"], "id", 3)
    assert cluster.agglomerative(df, ["a", "b"], "id", 3, micro=10).select("Cluster").distinct().count() == 3


def test_ward_in_rounds_is_the_exact_tree_at_any_size(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(90, 3)).round(4)
    df = spark.createDataFrame([(i, *r, float(i % 2)) for i, r in enumerate(x.tolist() + x[:5].tolist())], "id long, a double, b double, c double, odd double")
    want = {r["id"]: r["Cluster"] for r in cluster.agglomerative(df, ["a", "b", "c"], "id", 4).collect()}
    monkeypatch.setattr(cluster, "EXACT_POINTS", 12)
    methods = ModelSettings().arguments("agglomerative")
    got = {r["id"]: r["Cluster"] for r in cluster.cluster(df, ["a", "b", "c"], "agglomerative", "id", **methods).collect()}
    assert got == want and len(got) == 95


def test_forest_rows_follow_one_rule(spark):
    df = spark.range(2000).select("id", (F.col("id") % 17).cast("double").alias("x"))
    drawn = forest.tree_samples(df, "id", ["x"], 2000, 8, 32, 1).groupBy("tree").count().collect()
    assert {r["tree"]: r["count"] for r in drawn} == {t: 32 for t in range(8)}
    few = forest.tree_samples(df.where("id < 20"), "id", ["x"], 20, 8, 20, 1).groupBy("tree").count().collect()
    assert {r["count"] for r in few} == {20}
