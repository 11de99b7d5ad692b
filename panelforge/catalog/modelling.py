"""Reduction, clustering and evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..config import Density, ModelSettings, Partition
from ..operators import cluster, dbscan, density, evaluate, features, ward
from ..operators import reduce as components
from ..session import cut_lineage, settled, side_by_side
from .common import XS, cleaned_panel, feature_frame, points, points_sql, r, rounded, table
from .outlying import EPS, NEAR
from .panel_sql import FEATURES

QUERIES: dict = {}
ORACLES: dict = {}

#: Points of a leaf in the queries that must give the same rows from many leaves.
SPLIT_ROWS = 40
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

QUERIES["m1_variance_filter_lineitem"] = lambda s, d: components.variance_filter(table(s, d, "lineitem"), LINE, 0.1)
ORACLES["m1_variance_filter_lineitem"] = "SELECT l_quantity, l_extendedprice FROM lineitem"


def _variances(s, d):
    found = components.variances(table(s, d, "lineitem"), LINE)
    rows = [(c, round(v, 6), v > 0.1) for c, v in found.items()]
    return s.createDataFrame(rows, "column string, variance double, kept boolean")


QUERIES["m1_variances_lineitem"] = _variances
ORACLES["m1_variances_lineitem"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.1 AS kept FROM lineitem" for c in LINE
)

# --- components: two features have a closed form ------------------------------
PCA2 = """mom AS (SELECT avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS va, var_samp({b}) AS vb,
      covar_samp({a}, {b}) AS c FROM {t}),
    eig AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) * ((va - vb) / 2) + c * c) AS l1,
                   (va + vb) / 2 - sqrt(((va - vb) / 2) * ((va - vb) / 2) + c * c) AS l2 FROM mom),
    vec AS (SELECT *, c / sqrt(c * c + (l1 - va) * (l1 - va)) AS u, (l1 - va) / sqrt(c * c + (l1 - va) * (l1 - va)) AS w FROM eig),
    sgn AS (SELECT *, CASE WHEN abs(u) > abs(w) THEN sign(u) ELSE sign(w) END AS s1,
                   CASE WHEN abs(w) > abs(u) THEN sign(-w) ELSE sign(u) END AS s2 FROM vec)"""


def _pca(s, d):
    return components.fit_components(points(s, d), XS, 2)


QUERIES["m3_component_scores_embeddings"] = lambda s, d: rounded(
    _pca(s, d).scores(points(s, d), ["vec_id"]), ["PC1", "PC2"]
)
PAIR = ["c_acctbal", "c_nationkey"]
QUERIES["m3_component_scores_customer"] = lambda s, d: rounded(
    components.fit_components(table(s, d, "customer"), PAIR, 2).scores(table(s, d, "customer"), ["c_custkey"]), ["PC1", "PC2"], 3
)
ORACLES["m3_component_scores_customer"] = f"""WITH {PCA2.format(a=PAIR[0], b=PAIR[1], t='customer')}
    SELECT c_custkey, round(s1 * (({PAIR[0]} - ma) * u + ({PAIR[1]} - mb) * w), 3) + 0.0 AS "PC1",
           round(s2 * (({PAIR[0]} - ma) * -w + ({PAIR[1]} - mb) * u), 3) + 0.0 AS "PC2" FROM customer, sgn"""
QUERIES["m4_explained_variance_lineitem"] = lambda s, d: rounded(
    components.fit_components(table(s, d, "lineitem"), ["l_quantity", "l_discount"], 2).explained(s), ["ratio"]
)
ORACLES["m4_explained_variance_lineitem"] = f"""WITH {PCA2.format(a='l_quantity', b='l_discount', t='lineitem')}
    SELECT 'PC1' AS component, round(l1 / (l1 + l2), 6) + 0.0 AS ratio FROM eig
    UNION ALL SELECT 'PC2', round(l2 / (l1 + l2), 6) + 0.0 FROM eig"""


def _pca_panel(s, d):
    settings = ModelSettings()
    frame = feature_frame(s, d)
    fitted = components.fit_components(frame, settings.features, settings.components)
    return rounded(fitted.scores(frame, ["row_id"]), ["PC1", "PC2", "PC3"], 3)


QUERIES["m2_m3_component_scores_panel"] = _pca_panel


# --- k-means ---------------------------------------------------------------------
def _assigned(s, d):
    pts = points(s, d)
    centres = pts.groupBy("label").agg(*[F.avg(x).alias(x) for x in XS]).orderBy("label").collect()
    labelled = cluster.assign_nearest(pts, XS, [[row[x] for x in XS] for row in centres])
    return labelled.select("vec_id", F.col("Cluster").cast("long").alias("Cluster"))


QUERIES["m5_nearest_centre_embeddings"] = _assigned
ORACLES["m5_nearest_centre_embeddings"] = f"""WITH {points_sql()},
    cen AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, {', '.join(f'avg({x}) AS c{x}' for x in XS)} FROM pts GROUP BY label)
    SELECT vec_id, i AS "Cluster" FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id
        ORDER BY {' + '.join(f'({x} - c{x}) * ({x} - c{x})' for x in XS)}, i) AS rn FROM pts, cen) WHERE rn = 1"""
QUERIES["m5_kmeans_embeddings"] = lambda s, d: cluster.kmeans(points(s, d), XS, 4)[0].select("vec_id", "Cluster")

STARTS, LLOYD_ROUNDS = 4, 3


def _lloyd(s, d):
    pts = points(s, d)
    start = pts.orderBy("vec_id").limit(STARTS).select(*XS).collect()
    labelled, _ = cluster.lloyd_rounds(pts, XS, [list(row) for row in start], LLOYD_ROUNDS)
    return labelled.select("vec_id", F.col("Cluster").cast("long").alias("Cluster"))


def _lloyd_sql() -> str:
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    c0 AS (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS c, k, x AS m FROM v
        WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {STARTS}))"""]
    for i in range(LLOYD_ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, c FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY s, c) AS rn
        FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS s FROM v JOIN c{i} USING (k) GROUP BY ALL)) WHERE rn = 1)""")
        if i < LLOYD_ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, k, coalesce(f, m) AS m FROM c{i}
        LEFT JOIN (SELECT c, k, avg(x) AS f FROM a{i} JOIN v USING (vec_id) GROUP BY ALL) USING (c, k))""")
    return "WITH " + ",\n    ".join(steps) + f""" SELECT vec_id, c AS "Cluster" FROM a{LLOYD_ROUNDS}"""


QUERIES["m5_lloyd_rounds_embeddings"] = _lloyd
ORACLES["m5_lloyd_rounds_embeddings"] = _lloyd_sql()

# --- density ------------------------------------------------------------------------
QUERIES["m6_dbscan_embeddings"] = lambda s, d: dbscan.dbscan(points(s, d), "vec_id", XS, EPS, 5).select(
    "vec_id", "Cluster"
)
ORACLES["m6_dbscan_embeddings"] = f"""WITH RECURSIVE {points_sql()}, {NEAR.format(eps=f"CAST({EPS} AS DOUBLE)", m=5)},
    link AS (SELECT a, b FROM near JOIN core x ON a = x.id JOIN core y ON b = y.id),
    walk AS (SELECT id AS node, id AS root FROM core UNION SELECT link.b, walk.root FROM walk JOIN link ON walk.node = link.a),
    comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node),
    lab AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS label FROM comp),
    edge AS (SELECT a AS node, min(label) AS label FROM near JOIN lab ON b = lab.node WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT vec_id, coalesce(lab.label, edge.label, -1) AS "Cluster"
    FROM pts LEFT JOIN lab ON vec_id = lab.node LEFT JOIN edge ON vec_id = edge.node"""

QUERIES["m6_dbscan_split_embeddings"] = lambda s, d: dbscan.dbscan(
    points(s, d), "vec_id", XS, EPS, 5, cell_rows=SPLIT_ROWS
).select("vec_id", "Cluster")
ORACLES["m6_dbscan_split_embeddings"] = ORACLES["m6_dbscan_embeddings"]

#: Groups of a cell in the registered Ward queries; cells work together while more than ``ward.PAIR_ROWS`` are left.
WARD_CELL = 400
QUERIES["m7_ward_embeddings"] = lambda s, d: cluster.agglomerative(
    points(s, d), XS, "vec_id", 4, rounds=True, cell_rows=WARD_CELL
).select("vec_id", "Cluster")


def _ward_of_means(s, d):
    means = points(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("w"), *[F.avg(x).alias(f"x{i}") for i, x in enumerate(XS)])
    groups = cut_lineage(means.withColumn("id", F.col("label").cast("long")))
    return ward.ward_components(groups, len(XS), 4, cell_rows=8).select(F.col("id").alias("label"), F.col("component").alias("group"))


def _ward_means_sql(labels: int = 10, k: int = 4) -> str:
    """Merge after merge of the label means, each the pair with the least Ward height."""
    steps = [f"""g0 AS (SELECT label::BIGINT AS id, n::DOUBLE AS w, list(m ORDER BY k) AS x FROM (
        SELECT label, k, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)
        GROUP BY ALL) GROUP BY ALL), l0 AS (SELECT id, id AS root FROM g0)"""]
    for i in range(labels - k):
        steps.append(f"""b{i} AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.w AS wa, b.w AS wb, a.x AS xa, b.x AS xb FROM g{i} a JOIN g{i} b ON a.id < b.id
        ORDER BY 2 * a.w * b.w / (a.w + b.w) * pow(list_distance(a.x, b.x), 2), a.id, b.id LIMIT 1),
    g{i + 1} AS MATERIALIZED (SELECT id, w, x FROM g{i}, b{i} WHERE id NOT IN (a, b) UNION ALL
        SELECT a, wa + wb, list_transform(list_zip(xa, xb), lambda p: (wa * p[1] + wb * p[2]) / (wa + wb)) FROM b{i}),
    l{i + 1} AS (SELECT id, CASE WHEN root = b THEN a ELSE root END AS root FROM l{i}, b{i})""")
    last = labels - k
    return "WITH " + ",\n    ".join(steps) + f""" SELECT id AS label, min(id) OVER (PARTITION BY root) AS "group" FROM l{last}"""


QUERIES["m7_ward_label_means"] = _ward_of_means
ORACLES["m7_ward_label_means"] = _ward_means_sql()


QUERIES["m7_ward_micro_embeddings"] = lambda s, d: cluster.agglomerative(points(s, d), XS, "vec_id", 4, micro=64).select(
    "vec_id", "Cluster"
)


def _dispatched(s, d):
    pts = points(s, d)
    params = {"kmeans": {"k": 4}, "dbscan": {"eps": EPS, "min_samples": 5}, "agglomerative": {"k": 4, "rounds": True, "cell_rows": WARD_CELL}}

    def one(m):
        return settled(s, lambda: cluster.cluster(pts, XS, m, "vec_id", **params[m]).select("vec_id", "Cluster"))

    found = side_by_side(s, [lambda m=m: one(m) for m in params])
    parts = [df.select(F.lit(m).alias("method"), "vec_id", F.col("Cluster").cast("long").alias("Cluster")) for m, df in zip(params, found)]
    return reduce(lambda a, b: a.unionAll(b), parts)


QUERIES["m8_cluster_by_method_embeddings"] = _dispatched

# --- scores for the given labels ---------------------------------------------------
SQUARE = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in XS)
QUERIES["m9_silhouette_embeddings"] = lambda s, d: evaluate.silhouette_samples(points(s, d), XS, "label", "vec_id").select(
    F.col("id").alias("vec_id"), r("s").alias("s")
)
SIL = f"""{points_sql()}, size AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
    tot AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt({SQUARE})) AS t FROM pts a, pts b GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a,
           min(CASE WHEN own <> other THEN t / n END) AS b FROM tot JOIN size ON other = size.label GROUP BY vec_id),
    sil AS (SELECT vec_id, CASE WHEN n = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s FROM ab)"""
ORACLES["m9_silhouette_embeddings"] = f"WITH {SIL} SELECT vec_id, round(s, 6) + 0.0 AS s FROM sil"
QUERIES["m9_mean_silhouette_embeddings"] = lambda s, d: rounded(
    evaluate.silhouette(points(s, d), XS, "label", "vec_id"), ["silhouette"]
)
ORACLES["m9_mean_silhouette_embeddings"] = f"WITH {SIL} SELECT round(avg(s), 6) + 0.0 AS silhouette FROM sil"
QUERIES["m9_silhouette_squared_embeddings"] = lambda s, d: s.createDataFrame(
    [(round(evaluate.silhouette_squared(points(s, d), XS, "label"), 6),)], "silhouette double"
)
ORACLES["m9_silhouette_squared_embeddings"] = (
    f"WITH {SIL} SELECT round(avg(s), 6) + 0.0 AS silhouette FROM sil".replace(f"sum(sqrt({SQUARE}))", f"sum({SQUARE})")
)
QUERIES["m10_davies_bouldin_embeddings"] = lambda s, d: rounded(
    evaluate.davies_bouldin(points(s, d), XS, "label", "vec_id"), ["davies_bouldin"]
)
DIST = "sqrt(" + " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in XS) + ")"
ORACLES["m10_davies_bouldin_embeddings"] = f"""WITH {points_sql()},
    cen AS (SELECT label, {', '.join(f'avg({x}) AS {x}' for x in XS)} FROM pts GROUP BY label),
    sc AS (SELECT p.label, avg({DIST}) AS s FROM pts p JOIN cen c ON p.label = c.label GROUP BY p.label),
    rat AS (SELECT a.label, max((sa.s + sb.s) / sqrt({SQUARE})) AS m FROM cen a JOIN cen b ON a.label <> b.label
            JOIN sc sa ON sa.label = a.label JOIN sc sb ON sb.label = b.label GROUP BY a.label)
    SELECT round(avg(m), 6) + 0.0 AS davies_bouldin FROM rat"""


def _compared(s, d):
    from ..plans.model import compare_methods

    settings = ModelSettings(density=Density(radius=EPS), partition=Partition(cell_rows=WARD_CELL))
    pts = cut_lineage(points(s, d).select("vec_id", *XS))
    return compare_methods(pts, XS, "vec_id", settings)[1]


QUERIES["m11_method_comparison_embeddings"] = _compared

# --- sizes, joins, agreement ---------------------------------------------------------
QUERIES["m12_cluster_sizes_embeddings"] = lambda s, d: evaluate.cluster_sizes(table(s, d, "embeddings"), "label")
ORACLES["m12_cluster_sizes_embeddings"] = "SELECT label, count(*) AS count FROM embeddings GROUP BY label"


def _attached(s, d):
    quality = table(s, d, "labels").select("doc_id", F.col("quality").alias("Cluster"))
    return evaluate.attach_rows(quality, table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


QUERIES["m13_attach_rows_labels"] = _attached
ORACLES["m13_attach_rows_labels"] = """SELECT l.doc_id, quality AS "Cluster", lang, n_chars
    FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id"""
QUERIES["m14_ordinal_target_panel"] = lambda s, d: evaluate.ordinal_target(
    features.add_means(cleaned_panel(s, d))
).select("row_id", "target")
ORACLES["m14_ordinal_target_panel"] = FEATURES + """ SELECT row_id, round_even("MScore_mean", 0) AS target FROM features"""
QUERIES["m15_match_rate_labels"] = lambda s, d: rounded(
    evaluate.match_rate(table(s, d, "labels"), "quality", "toxic", {0: 1, 1: 0}), ["match_rate"]
)
ORACLES["m15_match_rate_labels"] = """SELECT round(avg(CASE WHEN 1 - quality = toxic THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS match_rate
    FROM labels"""
QUERIES["m15_best_match_rate_labels"] = lambda s, d: rounded(
    evaluate.match_rate(table(s, d, "labels"), "quality", "toxic"), ["match_rate"]
)
ORACLES["m15_best_match_rate_labels"] = """SELECT round(greatest(avg(CASE WHEN 1 - quality = toxic THEN 1.0 ELSE 0.0 END),
    avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)) * 100, 6) + 0.0 AS match_rate FROM labels"""
QUERIES["m16_contingency_labels"] = lambda s, d: evaluate.contingency(table(s, d, "labels"), "quality", "toxic")
ORACLES["m16_contingency_labels"] = "SELECT quality, toxic, count(*) AS count FROM labels GROUP BY ALL"


def _cluster_scatter(s, d):
    scores = rounded(_pca(s, d).scores(points(s, d), ["vec_id", "label"]), ["PC1", "PC2"])
    return density.scatter_sample(scores, ["PC1", "PC2"], "label", "vec_id", 0.25, ["label"])


QUERIES["m17_cluster_scatter_embeddings"] = _cluster_scatter
