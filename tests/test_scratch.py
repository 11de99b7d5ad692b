"""Disk: what a step stores goes with it, and comparisons of many copies go in passes."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from panelforge.config import Density, ModelSettings, Partition
from panelforge.operators import pairs
from panelforge.plans import model
from panelforge.session import DROP_SHUFFLES, ensure_checkpoint_dir, settled, store


def places(spark):
    ensure_checkpoint_dir(spark)
    return set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/stored-*"))


def test_a_settled_step_leaves_its_result_only(spark):
    before = places(spark)

    def inner():
        return store(spark.range(5)).withColumn("a", F.lit(1))

    def step():
        one = settled(spark, inner)
        assert len(places(spark) - before) == 1
        return store(one.join(store(spark.range(3)), "id")), one

    joined, one = settled(spark, step)
    assert len(places(spark) - before) == 2
    assert (joined.count(), one.count()) == (3, 5)
    assert spark.conf.get(DROP_SHUFFLES, None) is None


def test_a_step_that_fails_leaves_nothing(spark):
    before = places(spark)

    def step():
        store(spark.range(5))
        raise ValueError("no")

    with pytest.raises(ValueError):
        settled(spark, step)
    assert places(spark) == before


@pytest.mark.parametrize("moved", [40, 10**9])
def test_passes_meet_every_pair_once(spark, monkeypatch, moved):
    monkeypatch.setattr(pairs, "MOVED_ROWS", moved)
    monkeypatch.setattr(pairs, "SMALL_GROUP", 3)
    frame = spark.range(60).select((F.col("id") % 3 * F.col("id") % 2).alias("g"), "id", F.col("id").cast("double").alias("x0"))

    def every(q, c):
        import numpy as np

        i, j = np.divmod(np.arange(len(q["id"]) * len(c["id"])), len(c["id"]))
        return {"id": q["id"][i], "near": c["id"][j]}

    before = len(places(spark))
    got = sorted((r["id"], r["near"]) for r in pairs.compare(frame, frame, every, "id long, near long", 4).collect())
    of = {r["id"]: r["g"] for r in frame.collect()}
    assert got == sorted((a, b) for a in of for b in of if of[a] == of[b])
    assert (len(places(spark)) - before > 1) == (moved == 40)


def test_silhouettes_of_many_rows_are_taken_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(model, "ALONE_ROWS", 10)
    running, most, plain = [], [], model.score

    def scored(*args):
        running.append(1)
        most.append(len(running))
        time.sleep(0.5)
        found = plain(*args)
        running.pop()
        return found

    monkeypatch.setattr(model, "score", scored)
    df = spark.range(24).selectExpr("id", "id % 3 * 10 + id / 24 as a", "id % 5 / 10.0 as b")
    settings = ModelSettings(density=Density(radius=2.0), partition=Partition(clusters=3))
    before = places(spark)
    labelled, report = model.compare_methods(df, ["a", "b"], "id", settings)
    assert most == [1, 1, 1] and len(report.collect()) == 3
    # a labelled frame and a report per method are all that is left
    assert len(places(spark) - before) == 6
