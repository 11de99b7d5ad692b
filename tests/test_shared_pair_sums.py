"""Kendall and distance correlation of a stage compare its row pairs once."""

import numpy as np
import pytest

from panelforge.operators import concordance, correlation
from panelforge.plans import stats


def test_a_stage_compares_its_row_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, *[float(v) for v in rng.normal(size=3).round(1)]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    calls, plain = [], concordance.pair_sums

    def counted(*args, **params):
        calls.append(args)
        return plain(*args, **params)

    for module in (correlation, stats):
        monkeypatch.setattr(module, "pair_sums", counted, raising=False)
    cols = ["a", "b", "c"]
    found = stats.explore(df, cols, "row_id", 1)[0].collect()
    assert len(calls) == 1
    got = {(r["method"], r["col_i"], r["col_j"]): r["value"] for r in found}
    for name, frame in (("kendall", correlation.kendall(df, cols)), ("distance", correlation.distance_correlation(df, cols, "row_id"))):
        for r in frame.collect():
            assert got[name, r["col_i"], r["col_j"]] == pytest.approx(r["value"], abs=1e-12)


@pytest.mark.parametrize("digits", [8, 1, 0])
def test_signed_sums_are_those_of_all_pairs(digits):
    rng = np.random.default_rng(digits)
    x, y = rng.normal(size=157).round(digits), (rng.normal(size=157) ** 3).round(digits)
    dx, dy = x[:, None] - x[None], y[:, None] - y[None]
    k, d = concordance.signed_pair_sums(x, y, concordance._weights(x, y))
    assert k == np.triu(np.sign(dx) * np.sign(dy)).sum()
    assert d == pytest.approx(np.triu(dx * dy * np.sign(dx) * np.sign(dy)).sum(), rel=1e-9)
