import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.operators.profile import describe, observed, quality_report
from panelforge.operators.quantiles import column_quantiles, grouped_quantiles
from panelforge.operators.sampling import stratified_sample


def test_sample_sizes_are_floors(spark):
    rows = [(f"s{n}", f"s{n}-{i}") for n in (1, 9, 10, 19, 30) for i in range(n)] + [(None, "x")]
    df = spark.createDataFrame(rows, "stratum string, key string")
    got = {r["stratum"]: r["count"] for r in stratified_sample(df, "stratum", "key", 0.1).groupBy("stratum").count().collect()}
    assert got == {"s10": 1, "s19": 1, "s30": 3}


def test_sample_ignores_partitioning_and_takes_smallest_hashes(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 3500, "hot").otherwise("cold").alias("s"))
    one = {r["id"] for r in stratified_sample(df.repartition(1), "s", "id", 0.07).collect()}
    seven = {r["id"] for r in stratified_sample(df.repartition(7), "s", "id", 0.07).collect()}
    assert one == seven and len(one) == 245 + 105
    import hashlib

    hot = sorted(range(3500), key=lambda i: (hashlib.md5(f"{i}|42".encode()).hexdigest(), i))[:245]
    assert {i for i in one if i < 3500} == set(hot)


def test_quantiles_inside_brackets_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 6000
    values = np.where(rng.random(n) < 0.35, 2.5, rng.exponential(size=n))
    df = spark.createDataFrame(pd.DataFrame({"v": values, "u": rng.normal(size=n)}))
    probs = [0.0, 0.05, 0.37, 0.5, 0.951, 1.0]
    for accuracy in (100, 10_000):
        got = column_quantiles(df, ["v", "u"], probs, accuracy)
        pdf = df.toPandas()
        for c in ("v", "u"):
            assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=0, atol=1e-12)


def test_grouped_quantiles_with_one_hot_group(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.6, 0, rng.integers(1, 9, 4000)), "v": rng.normal(size=4000)})
    got = grouped_quantiles(spark.createDataFrame(pdf), ["g"], "v", [0.25, 0.9], 150).collect()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.9])
    assert len(got) == len(want)
    for r in got:
        assert abs(r["quantile"] - want[(r["g"], r["prob"])]) < 1e-12


def test_quality_counts_null_and_nan_as_one_missing_value(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (float("nan"), None), (0.0, "b")], "x double, s string")
    rows = {r["column"]: r for r in quality_report(df).collect()}
    x, s = rows["x"], rows["s"]
    assert (x["zero_count"], x["missing_count"], x["duplicate_count"], x["unique_count"]) == (1, 2, 1, 2)
    assert (s["zero_count"], s["missing_count"], s["duplicate_count"], s["unique_count"]) == (0, 1, 1, 2)
    assert x["missing_percentage"] == 50.0 and s["data_type"] == "string"


def test_approximate_report_has_the_same_shape(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("m"))
    exact, near = quality_report(df), quality_report(df, approximate=True)
    assert exact.columns == near.columns
    assert {r["column"]: r["zero_count"] for r in exact.collect()} == {r["column"]: r["zero_count"] for r in near.collect()}


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=333), "b": rng.integers(0, 50, 333).astype(float)})
    got = describe(spark.createDataFrame(pdf)).toPandas().set_index("column")
    want = pdf.describe().round(2)
    for c in ("a", "b"):
        assert np.allclose(got.loc[c, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want[c])


def test_observed_counts_rows_without_another_pass(spark):
    df, seen = observed(spark.range(17), "rows_seen")
    df.collect()
    assert seen.get["rows"] == 17
