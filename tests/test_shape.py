import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import shape as fx
from panelforge.operators import matrices, power, shape


def test_domains_of_plain_transforms(spark):
    df = spark.createDataFrame([(4.0,), (-4.0,), (None,), (-1e-8,)], "x double")
    x = F.col("x")
    got = df.select(fx.clipped_sqrt(x), fx.inverse_sqrt(x), fx.inverse(x)).collect()
    assert got[0][0] == 2.0 and abs(got[0][1] - 0.5) < 1e-8 and abs(got[0][2] - 0.25) < 1e-8
    assert got[1][0] == 0.0 and got[1][1] is None and got[1][2] < 0
    assert tuple(got[2]) == (None, None, None)
    assert tuple(got[3])[1:] == (None, None)


def _loglik(x, lam):
    up = x >= 0
    coef = np.where(up, lam, 2 - lam)
    log = np.log1p(np.abs(x))
    with np.errstate(all="ignore"):
        y = np.where(coef == 0, log, np.expm1(coef * log) / np.where(coef == 0, 1, coef)) * np.where(up, 1, -1)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.where(up, 1, -1) * log).sum()


def test_power_fit_reaches_the_likelihood_maximum(spark):
    rng = np.random.default_rng(1)
    base = rng.exponential(size=800) + 0.5
    pdf = pd.DataFrame({"plain": base, "small": base * 0.01, "negative": -base * 30, "mixed": rng.normal(size=800), "flat": 3.0})
    got = power.fit_power(spark.createDataFrame(pdf), list(pdf.columns))
    assert got["flat"] == 1.0
    assert got["small"] < -20  # the bracket has to grow far beyond the usual search interval
    for c in ("plain", "small", "negative", "mixed"):
        x, lam = pdf[c].to_numpy(), got[c]
        best = _loglik(x, lam)
        for step in (-0.05, -0.005, 0.005, 0.05):
            assert best >= _loglik(x, lam + step) - 1e-6


def test_power_partials_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=500) * 1e5}))
    grid = {"a": [-2.0, 0.0, 0.5, 1.0, 2.0]}
    one = {r["lam"]: r["score"] for r in power.score_lambdas(df.repartition(1), grid).collect()}
    many = {r["lam"]: r["score"] for r in power.score_lambdas(df.repartition(9), grid).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_box_cox_needs_positive_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    with pytest.raises(ValueError, match="positive"):
        power.fit_power(df, ["x"], "box-cox")


def test_numpy_blocks_equal_the_column_expression(spark):
    x = np.array([-3.0, -0.2, 0.0, 0.7, 12.0])
    for lam in (-1.5, 0.0, 0.25, 2.0):
        block, _ = power._power_block(x, np.array([lam]), "yeo-johnson")
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        got = [r[0] for r in df.select(fx.yeo_johnson(F.col("x"), F.lit(lam))).collect()]
        assert np.allclose(block[:, 0], got)


def test_report_has_null_measures_on_poles_and_constants(spark):
    df = spark.createDataFrame([(-1e-8, 2.0), (1.0, 2.0), (3.0, 2.0)], "p double, k double")
    rows = {(r["column"], r["transform"]): r for r in shape.shape_report(df, ["p", "k"], None, fx.TransformRegistry(False)).collect()}
    assert rows[("p", "inv")]["skew_after"] is None and rows[("p", "sqrt")]["skew_after"] is not None
    assert rows[("k", "sqrt")]["skew_before"] is None


# published outcome of one analysis: (column, transform, skew, kurtosis) and the choice made
PUBLISHED = [
    ("growth_Leverage_mean", "sqrt", 0.72, -0.74),
    ("growth_Leverage_mean", "power", 0.49, 1.51),
]


def test_choice_is_the_lowest_sum_and_ties_take_the_earlier(spark):
    rows = PUBLISHED + [("t", "inv", 0.5, -0.5), ("t", "sqrt", -1.0, 0.0), ("n", "sqrt", None, 0.1), ("n", "power", 9.0, 9.0), ("z", "inv", None, None)]
    table = spark.createDataFrame(rows, "column string, transform string, skew double, kurt double")
    got = {r["column"]: r["transform"] for r in shape.optimal_transforms(table).collect()}
    assert got == {"growth_Leverage_mean": "sqrt", "t": "sqrt", "n": "power", "z": "identity"}
    kept = shape.above_threshold(shape.optimal_transforms(table), 0.73)
    assert {r["column"] for r in kept.collect()} == {"growth_Leverage_mean", "n"}


def test_apply_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(1, 4.0, 5.0), (2, 9.0, 6.0)], "id int, a double, b double")
    out = shape.reshape_columns(df, {"a": "sqrt", "b": "unknown"})
    assert [tuple(r) for r in out.collect()] == [(1, 2.0, 5.0), (2, 3.0, 6.0)]
    powered = shape.reshape_columns(df, {"b": "power"}).toPandas()
    assert abs(powered["b"].mean()) < 1e-9 and abs(powered["b"].std(ddof=0) - 1) < 1e-9


def test_registry_takes_user_transforms(spark):
    registry = fx.TransformRegistry(include_power=False)
    registry.register("double", lambda x: x * 2)
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert [r[0] for r in shape.reshape_columns(df, {"a": "double"}, registry).collect()] == [2.0, 4.0]


def test_matrix_studies(spark):
    # 19 columns with the published off-diagonal sum: the mean has to follow
    assert round(80.6928 / (19**2 - 19), 4) == 0.2359
    names = ["a", "b", "c"]
    m = np.array([[1, 0.5, -0.25], [0.5, 1, 0.1], [-0.25, 0.1, 1]])
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    matrix = spark.createDataFrame(rows, "col_i string, col_j string, value double")
    norms = matrices.matrix_norms(matrix).first()
    assert tuple(norms) == (1.7, round(1.7 / 6, 4), round(float(np.linalg.norm(m)), 4))
    values = matrices.eigenvalues(matrix, names)
    got = [r["eigenvalue"] for r in values.orderBy("k").collect()]
    assert abs(sum(got) - 3) < 1e-12 and got == sorted(got, reverse=True)
    last = matrices.variance_explained(values).orderBy("k").collect()[-1]
    assert abs(last["cumulative"] - 1) < 1e-12
