"""Outlier filter queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..config import CONTINUOUS, StudySettings
from ..functions.scalars import col
from ..operators import forest, outliers
from .common import XS, feature_frame, points, points_sql, r, table
from .panel_sql import FEATURES

QUERIES: dict = {}
ORACLES: dict = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_OUT = ["l_orderkey", "l_linenumber", "l_returnflag", *LINE]


def _z_sql(source: str, cols, threshold: float, over: str, out: str) -> str:
    tests = " AND ".join(
        f'coalesce(abs("{c}" - avg("{c}") OVER ({over})) / nullif(stddev_pop("{c}") OVER ({over}), 0) < {threshold}, true)'
        for c in cols
    )
    return f"SELECT {out} FROM (SELECT *, ({tests}) AS keep FROM {source}) WHERE keep"


QUERIES["o1_zscore_lineitem"] = lambda s, d: outliers.zscore_filter(table(s, d, "lineitem"), LINE, 1.5).select(*LINE_OUT)
ORACLES["o1_zscore_lineitem"] = _z_sql("lineitem", LINE, 1.5, "", ", ".join(LINE_OUT))
QUERIES["o1_zscore_by_event_type"] = lambda s, d: outliers.zscore_filter(
    table(s, d, "events"), ["value"], 2.5, ["event_type"]
).select("event_id", "event_type", "value")
ORACLES["o1_zscore_by_event_type"] = _z_sql(
    "events", ["value"], 2.5, "PARTITION BY event_type", "event_id, event_type, value"
)


def _fence_sql(source: str, cols, factor: float, low: float, high: float, group: str, out: str) -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    bounds = ", ".join(
        f'quantile_cont("{c}", {low}) AS lo{i}, quantile_cont("{c}", {high}) AS hi{i}' for i, c in enumerate(cols)
    )
    tests = " AND ".join(
        f'"{c}" >= lo{i} - {factor} * (hi{i} - lo{i}) AND "{c}" <= hi{i} + {factor} * (hi{i} - lo{i})'
        for i, c in enumerate(cols)
    )
    join = f"JOIN b USING ({group})" if group else "CROSS JOIN b"
    return f"b AS (SELECT {g}{bounds} FROM {source} {by}) SELECT {out} FROM {source} {join} WHERE {tests}"


QUERIES["o2_quantile_fence_events"] = lambda s, d: outliers.iqr_filter(table(s, d, "events"), ["value"], 0.5).select(
    "event_id", "value"
)
ORACLES["o2_quantile_fence_events"] = "WITH " + _fence_sql("events", ["value"], 0.5, 0.05, 0.95, "", "event_id, value")
QUERIES["o2_quantile_fence_by_flag"] = lambda s, d: outliers.iqr_filter(
    table(s, d, "lineitem"), LINE, 0.0, (0.02, 0.98), ["l_returnflag"]
).select(*LINE_OUT)
ORACLES["o2_quantile_fence_by_flag"] = "WITH " + _fence_sql(
    "lineitem", LINE, 0.0, 0.02, 0.98, "l_returnflag", ", ".join(LINE_OUT)
)

# --- isolation forest: the same md5 draws grow the same node table in SQL ------
def forest_sql(trees: int = forest.TREES, rows: int = forest.TREE_ROWS, seed: int = 42) -> str:
    """CTE chain ending in ``nodes`` and ``score(vec_id, score)`` over the embeddings."""
    levels = math.ceil(math.log2(rows))
    hexed = lambda text, start, digits: f"('0x' || substr(md5({text}), {start}, {digits}))::BIGINT"
    node_text = f"'{seed}|' || tree || '|' || node"
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + {forest.EULER}) - 2.0 * ({n} - 1.0) / {n} END::DOUBLE"
    steps = [
        f"""pt AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
    total AS (SELECT count(*) AS n, least(count(*), {rows}) AS size FROM pt),
    hashed AS (SELECT vec_id, x, {hexed(f"vec_id || '|{seed}'", 1, 11)} AS a, {hexed(f"vec_id || '|{seed}'", 12, 11)} AS b FROM pt),
    dealt AS (SELECT tree, vec_id, x, (a + tree * b) % {forest.PLACES} AS place FROM hashed, range({trees}) AS t(tree)),
    r0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, vec_id, x FROM (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY place, vec_id::VARCHAR) AS rn FROM dealt, total
        WHERE place < floor({forest.PLACES} * least(1.0, 4.0 * size / n::DOUBLE))) WHERE rn <= size)"""
    ]
    for i in range(levels + 1):
        steps.append(f"""e{i} AS (SELECT tree, node, f, min(v) AS low, max(v) AS high FROM (
            SELECT tree, node, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS f FROM r{i}) GROUP BY ALL),
    s{i} AS (SELECT tree, node, list(f ORDER BY f) AS fs, {hexed(node_text, 1, 12)} / 281474976710656.0::DOUBLE AS u,
        {hexed(node_text, 13, 12)} / 281474976710656.0::DOUBLE AS w FROM e{i} WHERE high > low GROUP BY tree, node),
    p{i} AS (SELECT tree, node, fs[floor(u * len(fs))::INT + 1] AS f, w FROM s{i}),
    n{i} AS MATERIALIZED (SELECT c.tree, c.node, p.f, CASE WHEN low + w * (high - low) >= high THEN low ELSE low + w * (high - low) END AS cut,
        CASE WHEN p.f IS NULL THEN {i} + {path('n')} END AS depth
        FROM (SELECT tree, node, count(*) AS n FROM r{i} GROUP BY ALL) c LEFT JOIN {f"p{i}" if i < levels else f"(SELECT * FROM p{i} WHERE false)"} p
        ON c.tree = p.tree AND c.node = p.node LEFT JOIN e{i} e ON e.tree = p.tree AND e.node = p.node AND e.f = p.f)""")
        if i < levels:
            steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT r.tree, 2 * r.node + CASE WHEN x[f + 1] <= cut THEN 0 ELSE 1 END AS node, vec_id, x
        FROM r{i} r JOIN n{i} USING (tree, node) WHERE f IS NOT NULL)""")
    steps.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(levels + 1)) + ")")
    steps.append(f"w0 AS (SELECT vec_id, x, tree, 1::BIGINT AS node FROM pt, range({trees}) AS t(tree))")
    for i in range(levels):
        steps.append(f"""w{i + 1} AS MATERIALIZED (SELECT vec_id, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f + 1] <= cut THEN 2 * node
        ELSE 2 * node + 1 END AS node FROM w{i} JOIN nodes USING (tree, node))""")
    steps.append(f"""score AS (SELECT vec_id, pow(2.0, -sum(depth) / ({trees} * any_value({path('size')}))) AS score
        FROM w{levels} JOIN nodes USING (tree, node), total GROUP BY vec_id)""")
    return ",\n    ".join(steps)


def _nodes(s, d):
    nodes, _ = forest.grow_forest(points(s, d), "vec_id", XS)
    return nodes.select(F.col("tree").cast("long").alias("tree"), "node", F.col("feature").cast("long").alias("feature"), r("cut").alias("cut"), r("depth").alias("depth"))


QUERIES["o3_forest_nodes_embeddings"] = _nodes
ORACLES["o3_forest_nodes_embeddings"] = (
    f"WITH {forest_sql()} SELECT tree, node, f AS feature, round(cut, 6) + 0.0 AS cut, round(depth, 6) + 0.0 AS depth FROM nodes"
)
QUERIES["o3_scores_embeddings"] = lambda s, d: forest.anomaly_scores(points(s, d), "vec_id", XS).select(
    "vec_id", r("_score").alias("score")
)
ORACLES["o3_scores_embeddings"] = f"WITH {forest_sql()} SELECT vec_id, round(score, 6) + 0.0 AS score FROM score"
QUERIES["o3_isolation_forest_embeddings"] = lambda s, d: outliers.isolation_filter(
    points(s, d), XS, "vec_id", 0.05
).select("vec_id", *XS[:2])
ORACLES["o3_isolation_forest_embeddings"] = f"""WITH {forest_sql()}, cut AS (SELECT quantile_cont(-score, 0.05) AS q FROM score)
    SELECT vec_id, x[1] AS x1, x[2] AS x2 FROM pt JOIN score USING (vec_id), cut WHERE -score >= q"""


# --- local outlier factor ------------------------------------------------------
def lof_sql(source: str, key: str, cols, k: int) -> str:
    """CTE chain ending in ``lof(key, lof)``."""
    square = " + ".join(f'(a."{c}" - b."{c}") * (a."{c}" - b."{c}")' for c in cols)
    return f"""
    near AS (SELECT id, nid, dist FROM (
        SELECT a.{key} AS id, b.{key} AS nid, sqrt({square}) AS dist,
               row_number() OVER (PARTITION BY a.{key} ORDER BY {square}, b.{key}) AS rn
        FROM {source} a JOIN {source} b ON a.{key} <> b.{key}) WHERE rn <= {k}),
    kd AS (SELECT id, max(dist) AS kdist FROM near GROUP BY id),
    lrd AS (SELECT n.id, 1.0 / (sum(greatest(n.dist, kd.kdist)) / CAST({k} AS DOUBLE) + CAST(1e-10 AS DOUBLE)) AS lrd
            FROM near n JOIN kd ON n.nid = kd.id GROUP BY n.id),
    lof AS (SELECT n.id, sum(o.lrd) / CAST({k} AS DOUBLE) / max(p.lrd) AS lof
            FROM near n JOIN lrd o ON n.nid = o.id JOIN lrd p ON n.id = p.id GROUP BY n.id)"""


QUERIES["o4_lof_scores_embeddings"] = lambda s, d: outliers.lof_scores(points(s, d), XS, "vec_id", 20).select(
    "vec_id", r("_lof").alias("lof")
)
ORACLES["o4_lof_scores_embeddings"] = (
    f"WITH {points_sql()}, {lof_sql('pts', 'vec_id', XS, 20)} SELECT id AS vec_id, round(lof, 6) + 0.0 AS lof FROM lof"
)
QUERIES["o4_lof_filter_embeddings"] = lambda s, d: outliers.lof_filter(points(s, d), XS, "vec_id").select("vec_id", "label")
ORACLES["o4_lof_filter_embeddings"] = f"""WITH {points_sql()}, {lof_sql('pts', 'vec_id', XS, 20)},
    cut AS (SELECT quantile_cont(-lof, 0.05) AS q FROM lof)
    SELECT vec_id, label FROM pts JOIN lof ON vec_id = id CROSS JOIN cut WHERE -lof >= q"""

QUERIES["o4_lof_scores_split_embeddings"] = lambda s, d: outliers.lof_scores(points(s, d), XS, "vec_id", 20, cell_rows=40).select(
    "vec_id", r("_lof").alias("lof")
)
ORACLES["o4_lof_scores_split_embeddings"] = ORACLES["o4_lof_scores_embeddings"]

# --- density noise ---------------------------------------------------------------
NEAR = "near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON " + " + ".join(
    f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in XS
) + """ <= {eps} * {eps}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {m})"""
EPS = 1.16
QUERIES["o5_density_noise_embeddings"] = lambda s, d: outliers.noise_filter(
    points(s, d), XS, "vec_id", EPS, 5
).select("vec_id", "label")
ORACLES["o5_density_noise_embeddings"] = f"""WITH {points_sql()}, {NEAR.format(eps=f"CAST({EPS} AS DOUBLE)", m=5)}
    SELECT vec_id, label FROM pts WHERE vec_id IN (SELECT a FROM near JOIN core ON b = id)"""

QUERIES["o5_density_noise_split_embeddings"] = lambda s, d: outliers.noise_filter(
    points(s, d), XS, "vec_id", EPS, 5, cell_rows=40
).select("vec_id", "label")
ORACLES["o5_density_noise_split_embeddings"] = ORACLES["o5_density_noise_embeddings"]


# --- chain ---------------------------------------------------------------------
def _chain(s, d):
    kept = outliers.outlier_chain(feature_frame(s, d), CONTINUOUS, "row_id", StudySettings())
    return kept.select("row_id", r(col("TAsset_mean"), 3).alias("assets"), r(col("fur_roa")).alias("roa"))


QUERIES["o6_filter_chain_panel"] = _chain
ORACLES["o6_filter_chain_panel"] = (
    FEATURES
    + f""", {lof_sql('features', 'row_id', CONTINUOUS, 20)},
    cut AS (SELECT quantile_cont(-lof, 0.05) AS q FROM lof),
    s1 AS (SELECT features.* FROM features JOIN lof ON row_id = id CROSS JOIN cut WHERE -lof >= q),
    s2 AS (WITH {_fence_sql('s1', CONTINUOUS, 6.0, 0.05, 0.95, '', 's1.*')}),
    s3 AS ({_z_sql('s2', CONTINUOUS, 12.0, '', 'row_id, "TAsset_mean", fur_roa')})
    SELECT row_id, round("TAsset_mean", 3) + 0.0 AS assets, round(fur_roa, 6) + 0.0 AS roa FROM s3"""
)


def _bucket_mask(pdf):
    values = pdf.to_numpy()
    spread = values.std(axis=0)
    return (np.abs(values - values.mean(axis=0)) < 1.5 * np.where(spread > 0, spread, np.inf)).all(axis=1)


QUERIES["o7_bucket_filter_orders"] = lambda s, d: outliers.bucket_filter(
    table(s, d, "orders"), ["o_totalprice"], "o_orderkey", _bucket_mask
).select("o_orderkey", "o_totalprice")
