import numpy as np
import pandas as pd
import pytest

from panelforge.operators import correlation
from panelforge.operators.concordance import pair_sums, signed_pair_sums
from panelforge.operators.ranks import order_statistics

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 260
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n) * 10 + 100, "b": rng.integers(0, 6, n).astype(float)})
    pdf["c"] = np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n))  # one value holds 40 % of the rows
    pdf["d"] = pdf["a"] * 0.5 + rng.normal(size=n)
    return pdf


def matrix(df):
    return df.toPandas().pivot(index="col_i", columns="col_j", values="value").loc[COLS, COLS].to_numpy(dtype=float)


def signs(x):
    return np.sign(x[:, None] - x[None])


def brute(pdf, f):
    return np.array([[f(pdf[i].to_numpy(), pdf[j].to_numpy()) for j in COLS] for i in COLS])


def tau(x, y):
    a, b = signs(x), signs(y)
    return (a * b).sum() / np.sqrt((a**2).sum() * (b**2).sum())


def dcor(x, y):
    a, b = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    return np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))


def test_pearson_is_pairwise_complete(spark, data):
    pdf = data.copy()
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "d"] = np.nan
    got = matrix(correlation.pearson(spark.createDataFrame(pdf).repartition(5), COLS))
    assert np.allclose(got, pdf[COLS].corr().to_numpy(), atol=1e-12)


def test_constant_column_gives_null_not_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 2.0)], "id int, a double, k double")
    for got in (correlation.pearson(df, ["a", "k"]), correlation.kendall(df, ["a", "k"]), correlation.spearman(df, ["a", "k"], "id")):
        values = {(r["col_i"], r["col_j"]): r["value"] for r in got.collect()}
        assert values[("a", "a")] == 1.0 and values[("a", "k")] is None and values[("k", "k")] is None
    values = {(r["col_i"], r["col_j"]): r["value"] for r in correlation.distance_correlation(df, ["a", "k"], "id").collect()}
    assert values[("a", "k")] == 0.0 and values[("k", "k")] == 1.0


@pytest.mark.parametrize("rows", [250_000, 25])
def test_rank_and_distance_matrices_match_brute_force(spark, data, rows):
    df = spark.createDataFrame(data).repartition(3)
    assert np.allclose(matrix(correlation.spearman(df, COLS, "id", rows)), data[COLS].rank().corr().to_numpy(), atol=1e-12)
    assert np.allclose(matrix(correlation.kendall(df, COLS, rows)), brute(data, tau), atol=1e-12)
    assert np.allclose(matrix(correlation.distance_correlation(df, COLS, "id", rows)), brute(data, dcor), atol=1e-9)


def test_coarsened_grid_gives_the_same_sums(spark, data):
    df = spark.createDataFrame(data)
    one = {(r["i"], r["j"]): (r["k"], r["d"]) for r in pair_sums(df, COLS)[0].collect()}
    two = {(r["i"], r["j"]): (r["k"], r["d"]) for r in pair_sums(df, COLS, 8, grid_side=5)[0].collect()}
    assert one.keys() == two.keys()
    for key in one:
        assert one[key][0] == two[key][0] and abs(one[key][1] - two[key][1]) < 1e-6 * abs(one[key][1])


def test_signed_sums_against_all_pairs():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 12, 90).astype(float), rng.normal(size=90).round(1)
    w = np.column_stack([np.ones(90), x, y, x * y])
    i, j = np.triu_indices(90, 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    k, d = signed_pair_sums(x, y, w)
    assert k == s.sum() and abs(d - (s * (x[i] - x[j]) * (y[i] - y[j])).sum()) < 1e-8


def test_order_statistics(spark, data):
    got = order_statistics(spark.createDataFrame(data), "id", ["c"], 20).toPandas().sort_values("id")
    c = data["c"].to_numpy()
    assert np.allclose(got["r0"], data["c"].rank())
    assert np.allclose(got["a0"], np.abs(c[:, None] - c[None]).sum(1))
