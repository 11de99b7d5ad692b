"""Source and sink queries: everything written is read back before it is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import correlation, evaluate
from ..operators.profile import quality_report
from ..session import ensure_checkpoint_dir
from ..sources import tables as t
from .common import XS, points, r, rounded, table
from .correlating import pearson_sql
from .profiling import ORACLES as PROFILE

QUERIES: dict = {}
ORACLES: dict = {}


def _folder(spark) -> str:
    """A new folder under the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


def _export(s, d):
    paths = t.export_tables({n: table(s, d, n) for n in ("nation", "supplier")}, _folder(s))
    return t.load_parquet(s, paths[1], table(s, d, "supplier").schema)


QUERIES["s2_export_table_supplier"] = _export
ORACLES["s2_export_table_supplier"] = "SELECT * FROM supplier"


def _union(s, d):
    return t.scan_files(s, [f"{d}/benchmark.parquet", f"{d}/documents.parquet"]).select(
        "source_table", "item_id", "doc_id", "lang", F.length("text").alias("length")
    )


QUERIES["s3_scan_union_texts"] = _union
ORACLES["s3_scan_union_texts"] = """SELECT source_table, item_id, doc_id, lang, CAST(length(text) AS INTEGER) AS length FROM (
    SELECT 'benchmark' AS source_table, * FROM benchmark UNION ALL BY NAME SELECT 'documents' AS source_table, * FROM documents)"""


def _same_schema(s, d):
    folder = _folder(s)
    lines = table(s, d, "orders")
    halves = {"early": lines.where("o_orderdate < '1998-01-01'"), "late": lines.where("o_orderdate >= '1998-01-01'")}
    paths = t.export_tables(halves, folder)
    return t.scan_files(s, paths, lines.schema).select("source_table", "o_orderkey", "o_totalprice")


QUERIES["s3_scan_partitions_orders"] = _same_schema
ORACLES["s3_scan_partitions_orders"] = """SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS source_table,
    o_orderkey, o_totalprice FROM orders"""


def _absent(s, d):
    path = f"{_folder(s)}/combined.parquet"
    t.save_if_absent(table(s, d, "region"), path)
    t.save_if_absent(table(s, d, "region").limit(0), path)  # kept as it was
    return t.load_parquet(s, path)


QUERIES["s4_write_if_absent_region"] = _absent
ORACLES["s4_write_if_absent_region"] = "SELECT * FROM region"


def _round_trip(s, d):
    path = f"{_folder(s)}/customer.parquet"
    t.save_parquet(table(s, d, "customer"), path)
    return t.load_parquet(s, path)


QUERIES["s5_parquet_round_trip_customer"] = _round_trip
ORACLES["s5_parquet_round_trip_customer"] = "SELECT * FROM customer"


def _stage(s, d):
    store = t.StageStore(s, _folder(s), "one")
    store.save(table(s, d, "orders"), "raw")
    return store.load("raw").select("o_orderkey", "o_orderstatus", "o_totalprice")


QUERIES["s6_stage_checkpoint_orders"] = _stage
ORACLES["s6_stage_checkpoint_orders"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"

LINE = ["l_quantity", "l_extendedprice", "l_discount"]


def _json(s, d):
    path = f"{_folder(s)}/matrix.json"
    matrix = correlation.pearson(table(s, d, "lineitem"), LINE)
    t.write_json_lines(matrix, path)
    return rounded(t.read_json_lines(s, path, matrix.schema), ["value"])


QUERIES["s8_json_round_trip_matrix"] = _json
ORACLES["s8_json_round_trip_matrix"] = pearson_sql("lineitem", LINE)


def _manifest(s, d):
    path = f"{_folder(s)}/runs"
    rows = table(s, d, "orders").count()
    t.append_manifest(s, path, "a", "stats", "done", {"rows": rows})
    t.append_manifest(s, path, "b", "stats", "failed", {"rows": rows})
    return t.load_parquet(s, path)


QUERIES["s10_run_manifest_orders"] = _manifest
ORACLES["s10_run_manifest_orders"] = """SELECT run_id, 'stats' AS stage, status, '{"rows": ' || (SELECT count(*) FROM orders) || '}' AS config
    FROM (VALUES ('a', 'done'), ('b', 'failed')) v(run_id, status)"""


def _metrics(s, d):
    path = f"{_folder(s)}/clustering_metrics_run_1"
    score = evaluate.davies_bouldin(points(s, d), XS, "label", "vec_id")
    t.write_json_lines(score.select(F.lit(1).alias("run"), F.lit("given").alias("method"), r("davies_bouldin").alias("davies_bouldin")), path)
    return t.read_json_lines(s, path, "run int, method string, davies_bouldin double")


QUERIES["s11_metrics_sink_embeddings"] = _metrics


def _written_once(s, d):
    """The report of the first write stays; the second, of another table, is ignored."""
    path = f"{_folder(s)}/quality"
    t.save_if_absent(quality_report(table(s, d, "lineitem")), path)
    t.save_if_absent(quality_report(table(s, d, "orders")), path)
    return t.load_parquet(s, path)


QUERIES["q3_report_written_once_lineitem"] = _written_once
ORACLES["q3_report_written_once_lineitem"] = PROFILE["q1_quality_report_lineitem"]


def _metrics_sql() -> str:
    from .modelling import ORACLES as MODEL

    return f"SELECT 1 AS run, 'given' AS method, davies_bouldin FROM ({MODEL['m10_davies_bouldin_embeddings']})"


ORACLES["s11_metrics_sink_embeddings"] = _metrics_sql()
