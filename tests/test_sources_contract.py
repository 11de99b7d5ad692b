import json
import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from dataclasses import asdict

from panelforge.config import ModelSettings, StudySettings
from panelforge.operators.groups import column_sets
from panelforge.plans.data import run_data_plan
from panelforge.session import ensure_checkpoint_dir
from panelforge.sources import tables
from panelforge.sources.panel import company_panel
from tools.check_oracles import TABLES, rows_of


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="panelforge-test-")


def test_table_names():
    assert tables.normalize_table_name("1-20K") == "t1_20k"


def test_jdbc_scan_asks_for_its_bounds(monkeypatch):
    calls = []

    class Frame:
        def first(self):
            return (3, 90)

    class Reader:
        def jdbc(self, url, table, **kwargs):
            calls.append((table, kwargs))
            return Frame()

    class Session:
        read = Reader()

    tables.read_jdbc(Session(), "jdbc:x", "t1", "id", 8)
    assert "min(id)" in calls[0][0]
    assert calls[1][0] == "t1" and calls[1][1]["lowerBound"] == 3 and calls[1][1]["upperBound"] == 91
    assert calls[1][1]["numPartitions"] == 8 and calls[1][1]["properties"]["fetchsize"] == "10000"


def test_union_keeps_names_and_fills_absent_columns(spark, folder):
    a = spark.createDataFrame([(1, "x")], "id long, s string")
    b = spark.createDataFrame([(2, 0.5)], "id long, v double")
    paths = tables.export_tables({"t1": a, "t2": b}, folder)
    tables.export_tables({"stale": a}, folder)
    rows = tables.scan_files(spark, paths).orderBy("id").collect()
    assert [(r["id"], r["s"], r["v"], r["source_table"]) for r in rows] == [(1, "x", None, "t1"), (2, None, 0.5, "t2")]


def test_stages_of_two_runs_are_apart(spark, folder):
    one, two = tables.StageStore(spark, folder, "1"), tables.StageStore(spark, folder, "2")
    one.save(spark.range(3), "raw")
    two.save(spark.range(5), "raw")
    assert one.load("raw").count() == 3 and two.load("raw").count() == 5


def test_manifest_rows_append(spark, folder):
    tables.append_manifest(spark, f"{folder}/m", "a", "stats", "failed", asdict(StudySettings()))
    tables.append_manifest(spark, f"{folder}/m", "b", "model", "done", asdict(ModelSettings()))
    rows = {r["run_id"]: r for r in spark.read.parquet(f"{folder}/m").collect()}
    assert rows["a"]["status"] == "failed" and json.loads(rows["b"]["config"])["partition"]["clusters"] == 4


def test_checkpoint_folder_is_taken_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_data_plan_writes_its_stages(spark, small_dir, folder):
    store = tables.StageStore(spark, folder, "1")
    result = run_data_plan(company_panel(spark, small_dir), store, fraction=1.0)
    assert result.features.count() == 41
    assert result.sets == column_sets(result.features.columns) and len(result.sets["continuous"]) == 22
    for name in ("quality", "describe", "sectors", "row_audit", "raw"):
        assert os.path.isdir(store.path(name))
    assert store.load("sectors").count() <= 25


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


QUICK = [
    "q1_quality_report_lineitem",
    "p1_stratified_sample_orders",
    "c6_label_encode_part",
    "f10_feature_build",
    "o2_quantile_fence_events",
    "o4_lof_filter_embeddings",
    "d6_optimal_transform_panel",
    "r4_distance_correlation_customer",
    "m6_dbscan_embeddings",
    "m9_silhouette_embeddings",
    "m10_davies_bouldin_embeddings",
    "s3_scan_union_texts",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, small_dir)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 22
