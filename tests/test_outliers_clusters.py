import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import cluster, dbscan, density, evaluate, forest, outliers, reduce
from panelforge.operators.components import connected_components
from panelforge.operators.neighbors import join_points, nearest_neighbors, weighted_points


@pytest.fixture(scope="module")
def blobs():
    """Two blobs, scattered points and 40 copies of one point."""
    rng = np.random.default_rng(1)
    x = np.vstack(
        [
            rng.normal(size=(80, 2)) * 0.3,
            rng.normal(size=(80, 2)) * 0.5 + 3,
            rng.uniform(-2, 6, (40, 2)),
            np.tile([[5.0, 5.0]], (40, 1)),
        ]
    ).round(3)
    return pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})


def distances(pdf):
    x = pdf[["a", "b"]].to_numpy()
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_lof(pdf, k):
    d = distances(pdf)
    np.fill_diagonal(d, -1)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    nd = np.take_along_axis(d, near, 1)
    radius = nd[:, -1]
    lrd = 1 / (np.maximum(radius[near], nd).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def brute_dbscan(pdf, eps, m):
    d = distances(pdf) <= eps
    core = d.sum(1) >= m
    label, c = -np.ones(len(pdf), int), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], stack = c, [i]
            while stack:
                u = stack.pop()
                for v in np.flatnonzero(d[u] & core & (label < 0)):
                    label[v] = c
                    stack.append(v)
            c += 1
    for i in np.flatnonzero(~core):
        if (d[i] & core).any():
            label[i] = label[np.flatnonzero(d[i] & core)].min()
    return label


def test_lof_with_copies_matches_brute_force(spark, blobs):
    got = outliers.lof_scores(spark.createDataFrame(blobs).repartition(4), ["a", "b"], "id", 10).toPandas().sort_values("id")
    assert np.allclose(got["_lof"], brute_lof(blobs, 10), rtol=1e-9)
    kept = outliers.lof_filter(spark.createDataFrame(blobs), ["a", "b"], "id", 10, 0.1).toPandas()
    nof = -brute_lof(blobs, 10)
    assert set(kept["id"]) == set(np.flatnonzero(nof >= np.percentile(nof, 10)))


def test_neighbors_do_not_depend_on_the_number_of_cells(spark, blobs):
    points = weighted_points(spark.createDataFrame(blobs), "id", ["a", "b"])
    frames = [
        nearest_neighbors(points, 2, 7, rows).toPandas().sort_values(["id", "nid"]).reset_index(drop=True) for rows in (4000, 20)
    ]
    assert frames[0].equals(frames[1])


@pytest.mark.parametrize("eps,m,rows", [(0.15, 5, 4000), (0.5, 45, 25)])
def test_dbscan_matches_brute_force(spark, blobs, eps, m, rows):
    df = spark.createDataFrame(blobs).repartition(3)
    want = brute_dbscan(blobs, eps, m)
    got = join_points(df, ["a", "b"], dbscan.dbscan_points(df, "id", ["a", "b"], eps, m, rows)).toPandas().sort_values("id")
    assert (got["label"].to_numpy() == want).all()
    kept = outliers.noise_filter(df, ["a", "b"], "id", eps, m).toPandas()
    assert set(kept["id"]) == set(np.flatnonzero(want >= 0))


def test_dbscan_border_takes_smallest_cluster_and_all_noise(spark):
    x = [0.0, 0.1, 0.2, 1.0, 1.8, 1.9, 2.0]  # 1.0 touches both ends
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, v double")
    got = dbscan.dbscan(df, "id", ["v"], 0.81, 4).orderBy("id").collect()
    assert [r["Cluster"] for r in got] == list(brute_dbscan_1d(x, 0.81, 4))
    assert {r["Cluster"] for r in dbscan.dbscan(df, "id", ["v"], 0.01, 3).collect()} == {-1}


def brute_dbscan_1d(x, eps, m):
    return brute_dbscan(pd.DataFrame({"a": x, "b": 0.0}), eps, m)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 130), 500]], "id long")
    got = {r["id"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 500: 500}


def test_statistical_filters(spark, blobs):
    df = spark.createDataFrame(blobs).withColumn("k", F.lit(2.0)).withColumn("g", F.col("id") % 2)
    z = np.abs((blobs[["a", "b"]] - blobs[["a", "b"]].mean()) / blobs[["a", "b"]].std(ddof=0))
    got = outliers.zscore_filter(df, ["a", "b", "k"], 1.5).toPandas()  # the constant column keeps rows
    assert set(got["id"]) == set(np.flatnonzero((z < 1.5).all(axis=1)))
    q = blobs[["a", "b"]].quantile([0.1, 0.9])
    inside = ((blobs[["a", "b"]] >= q.iloc[0]) & (blobs[["a", "b"]] <= q.iloc[1])).all(axis=1)
    assert set(outliers.iqr_filter(df, ["a", "b"], 0.0, (0.1, 0.9)).toPandas()["id"]) == set(np.flatnonzero(inside))
    grouped = outliers.zscore_filter(df, ["a"], 1.0, ["g"]).toPandas()
    zg = blobs.groupby(blobs["id"] % 2)["a"].transform(lambda s: (s - s.mean()).abs() / s.std(ddof=0))
    assert set(grouped["id"]) == set(np.flatnonzero(zg < 1.0))
    with pytest.raises(ValueError):
        outliers.drop_outliers(df, ["a"], "nope", "id")


def test_bucket_filter_is_partition_independent(spark, blobs):
    df = spark.createDataFrame(blobs)
    mask = lambda pdf: pdf["a"] <= pdf["a"].median()
    one = {r["id"] for r in outliers.bucket_filter(df.repartition(1), ["a"], "id", mask, 60).collect()}
    six = {r["id"] for r in outliers.bucket_filter(df.repartition(6), ["a"], "id", mask, 60).collect()}
    assert one == six and 100 <= len(one) <= 160


def test_isolation_forest_share_and_determinism(spark, blobs):
    df = spark.createDataFrame(blobs)
    one = {r["id"] for r in outliers.isolation_filter(df.repartition(1), ["a", "b"], "id", 0.05).collect()}
    five = {r["id"] for r in outliers.isolation_filter(df.repartition(5), ["a", "b"], "id", 0.05).collect()}
    assert one == five and abs(len(one) - 0.95 * len(blobs)) <= 2
    scores = forest.anomaly_scores(df, "id", ["a", "b"]).toPandas()["_score"]
    assert scores.between(0, 1).all()


def test_ward_is_exact_on_few_points_and_close_on_micro_clusters(spark, blobs):
    df = spark.createDataFrame(blobs)
    got = cluster.agglomerative(df, ["a", "b"], "id", 4).toPandas().sort_values("id")["Cluster"].to_numpy()
    x = blobs[["a", "b"]].to_numpy()
    groups = [[i] for i in range(len(x))]
    while len(groups) > 4:  # direct merging by smallest increase of squared error
        best = None
        cents = np.array([x[g].mean(0) for g in groups])
        sizes = np.array([len(g) for g in groups])
        d = ((cents[:, None] - cents[None]) ** 2).sum(-1) * sizes[:, None] * sizes[None] / (sizes[:, None] + sizes[None])
        np.fill_diagonal(d, np.inf)
        best = np.unravel_index(d.argmin(), d.shape)
        a, b = sorted(best)
        groups[a] += groups.pop(b)
    want = {frozenset(g) for g in groups}
    assert {frozenset(np.flatnonzero(got == c)) for c in set(got)} == want
    rough = cluster.agglomerative(df, ["a", "b"], "id", 4, micro=60).toPandas()["Cluster"]
    assert rough.nunique() == 4


def test_kmeans_labels_follow_centre_order(spark, blobs):
    labelled, centres = cluster.kmeans(spark.createDataFrame(blobs), ["a", "b"], 3)
    assert (np.diff(centres[:, 0]) >= 0).all()
    x = blobs[["a", "b"]].to_numpy()
    want = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert (labelled.toPandas().sort_values("id")["Cluster"].to_numpy() == want).all()
    many = cluster.assign_nearest(spark.createDataFrame(blobs), ["a", "b"], x[:100])
    assert (many.toPandas().sort_values("id")["Cluster"].to_numpy()[:100] == np.array([((x[:100] - p) ** 2).sum(1).argmin() for p in x[:100]])).all()


def test_dispatcher_rejects_unknown_methods_and_leaky_features(spark, blobs):
    df = spark.createDataFrame(blobs)
    with pytest.raises(ValueError):
        cluster.cluster(df, ["a"], "nope", "id")
    with pytest.raises(ValueError):
        cluster.cluster(df, ["a", "Cluster"], "kmeans", "id")


@pytest.mark.parametrize("rows", [20_000, 40])
def test_silhouette_and_davies_bouldin_match_brute_force(spark, blobs, rows):
    pdf = blobs.copy()
    pdf["label"] = np.r_[np.zeros(80), np.ones(80), np.full(79, 2), [3]].astype(int)  # 3 is a singleton
    df = spark.createDataFrame(pdf)
    d, lab = distances(pdf), pdf["label"].to_numpy()
    want = []
    for i in range(len(pdf)):
        own = (lab == lab[i]).sum()
        if own == 1:
            want.append(0.0)
            continue
        a = d[i][lab == lab[i]].sum() / (own - 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = evaluate.silhouette_samples(df, ["a", "b"], "label", "id", rows).toPandas().sort_values("id")
    assert np.allclose(got["s"], want, atol=1e-12)
    x = pdf[["a", "b"]].to_numpy()
    cents = {c: x[lab == c].mean(0) for c in set(lab)}
    scatter = {c: np.sqrt(((x[lab == c] - cents[c]) ** 2).sum(1)).mean() for c in set(lab)}
    db = np.mean([max((scatter[i] + scatter[j]) / np.linalg.norm(cents[i] - cents[j]) for j in cents if j != i) for i in cents])
    assert abs(evaluate.davies_bouldin(df, ["a", "b"], "label", "id").first()[0] - db) < 1e-12
    assert -1 <= evaluate.silhouette_squared(df, ["a", "b"], "label") <= 1


def test_silhouette_needs_two_clusters(spark, blobs):
    df = spark.createDataFrame(blobs).withColumn("label", F.lit(0))
    with pytest.raises(ValueError):
        evaluate.silhouette(df, ["a", "b"], "label", "id")


def test_components_explain_variance_and_keep_rows(spark, blobs):
    pdf = blobs.assign(c=blobs["a"] * 2 - blobs["b"])
    fitted = reduce.fit_components(spark.createDataFrame(pdf), ["a", "b", "c"], 2)
    x = pdf[["a", "b", "c"]].to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(fitted.ratios, values[:2] / values.sum())
    scores = fitted.scores(spark.createDataFrame(pdf), ["id"]).toPandas().sort_values("id")
    assert np.allclose(scores[["PC1", "PC2"]].mean(), 0, atol=1e-9)
    assert np.allclose(scores[["PC1", "PC2"]].var(), values[:2])
    assert reduce.select_by_variance(spark.createDataFrame(pdf).withColumn("k", F.lit(1.0)), ["a", "k"]) == ["a"]


def test_targets_round_half_even_and_null_never_matches(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (1, None)], "c int, MScore_mean double")
    targets = evaluate.ordinal_target(df)
    assert [r["target"] for r in targets.collect()] == [0.0, 2.0, 2.0, None]
    assert evaluate.match_rate(targets, "c", "target", {0: 0, 1: 2, 2: 2}).first()[0] == 75.0
    assert evaluate.match_rate(targets, "c", "target", {}).first()[0] == 50.0
    assert evaluate.best_mapping(evaluate.contingency(targets, "c", "target"), "c", "target")[0] == 0


def test_density_tables(spark, blobs):
    df = spark.createDataFrame(blobs)
    curve = density.density_curve(df, ["a"]).toPandas().sort_values("point")
    assert len(curve) == 200 and abs(np.trapezoid(curve["density"], curve["x"]) - 1) < 0.01
    assert density.histogram(df, ["a", "b"], 10).groupBy("column").agg(F.sum("count")).toPandas()["sum(count)"].tolist() == [240, 240]
