import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.scalars import col, row_mean, row_std
from panelforge.operators import clean, features, groups


def test_first_complete_row_wins(spark):
    df = spark.createDataFrame(
        [(1, 9, "A", None), (2, 9, "A", 5.0), (3, 9, "A", 6.0), (4, 9, "B", 7.0), (5, 9, None, 1.0)],
        "row_id long, No int, `Company name` string, x double",
    )
    got = sorted((r["row_id"], r["x"]) for r in clean.remove_rows(df).collect())
    assert got == [(2, 5.0), (4, 7.0)]


def test_unmapped_category_raises_or_is_null(spark):
    df = spark.createDataFrame([("Italy",), ("Peru",), (None,)], "Country string")
    maps = {"Country": {"Italy": 0}}
    assert [r[0] for r in clean.map_values(df, maps, "null").collect()] == [0, None, None]
    with pytest.raises(Exception, match="Peru"):
        clean.map_values(df, maps, "error").collect()
    with pytest.raises(KeyError):
        clean.map_values(df, {"absent": {}}, "null")


def test_codes_agree_between_small_and_ranged_numbering(spark):
    df = spark.createDataFrame([(v,) for v in "pear apple fig apple date kiwi fig".split()] + [(None,)], "f string")
    one = sorted(map(tuple, clean.category_codes(df, "f").collect()))
    two = sorted(map(tuple, clean.category_codes(df, "f", small=2).collect()))
    assert one == two == [("apple", 0), ("date", 1), ("fig", 2), ("kiwi", 3), ("pear", 4)]
    encoded = clean.label_encode(df, "f", small=2)[0]
    assert [r[0] for r in encoded.orderBy("f").collect()] == [None, 0, 0, 1, 2, 2, 3, 4]


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in clean.standard_scale(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_replacements_are_simultaneous(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, -1)], "c int")
    assert [r[0] for r in clean.replace_values(df, "c", {0: 1, 1: 2, 2: 0}).collect()] == [1, 2, 0, 3, -1]


def test_row_statistics_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, 2.0), (None, None, None)], "a double, b double, c double")
    cols = [col(c) for c in "abc"]
    got = df.select(row_mean(cols).alias("m"), *cols).select("m", row_std(cols, F.col("m"))).collect()
    assert got[0][0] == 2.0 and abs(got[0][1] - np.sqrt(2)) < 1e-12
    assert tuple(got[1]) == (2.0, None) and tuple(got[2]) == (None, None)


def _panel():
    rng = np.random.default_rng(0)
    years, metrics = ("2020", "2019", "2018"), ("EBIT", "MScore")
    pdf = pd.DataFrame({f"{m}.{y}": rng.integers(0, 4, 40).astype(float) for m in metrics for y in years})
    pdf["row_id"] = np.arange(40)
    return pdf, metrics, years


def test_growth_imputes_zero_denominators_with_the_column_mean(spark):
    pdf, metrics, years = _panel()
    got = features.add_growth(spark.createDataFrame(pdf), metrics, years).toPandas().sort_values("row_id")
    for m in metrics:
        parts = []
        for cur, prev in zip(years, years[1:]):
            g = (pdf[f"{m}.{cur}"] - pdf[f"{m}.{prev}"]) / pdf[f"{m}.{prev}"].replace(0, np.nan)
            parts.append(g.fillna(g.mean()))
        assert np.allclose(got[f"growth_{m}_mean"].to_numpy(), pd.concat(parts, axis=1).mean(axis=1).to_numpy())


def test_volatility_matches_pandas_and_tolerates_missing_years(spark):
    pdf, metrics, years = _panel()
    pdf = pdf.drop(columns=["EBIT.2018"])
    got = features.add_volatility(spark.createDataFrame(pdf), metrics, years).toPandas().sort_values("row_id")
    assert np.allclose(got["volatility_EBIT"], pdf[["EBIT.2020", "EBIT.2019"]].std(axis=1))
    assert np.allclose(got["volatility_MScore"], pdf[[f"MScore.{y}" for y in years]].std(axis=1))
    assert not [c for c in got.columns if c.startswith("_")]


def test_all_missing_growth_stays_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "`A.2020` double, `A.2019` double")
    assert [r[0] for r in features.add_growth(df, ["A"], ["2020", "2019"]).select("growth_A_mean").collect()] == [None, None]


def test_group_sizes_and_ordered_difference():
    columns = [f"{m}_mean" for m in features.METRICS] + [f"growth_{m}_mean" for m in features.METRICS]
    columns += [f"volatility_{m}" for m in features.METRICS] + ["fur_debt_to_eq", "fur_op_marg", "fur_asset_turnover", "fur_roa"]
    g = groups.column_sets(columns)
    assert {k: len(v) for k, v in g.sets.items()} == {"all": 25, "fur": 4, "grow": 6, "raw_mean": 6, "vol": 6, "score": 3}
    assert groups.without(["b", "a", "c"], ["a"]) == ("b", "c")
    names = ["EBIT.2020", "EBIT.2019", "EBITDA.2020"]
    assert groups.metric_columns(names, "EBIT", years=["2020"]) == ("EBIT.2020",)
    assert groups.metric_columns(names, "EBIT", "EBITDA", years=["2020"]) == ("EBIT.2020", "EBITDA.2020")
