"""Correlation, density and matrix queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONTINUOUS, ORDINAL, STAGES, StudySettings
from ..operators import correlation, density, matrices
from ..operators.groups import column_sets, without
from .common import XS, feature_frame, long_sql, points, r, scratch_store, table
from .panel_sql import FEATURES

QUERIES: dict = {}
ORACLES: dict = {}

_SETS = column_sets([*CONTINUOUS, *ORDINAL])
#: The 19 columns that a study explores.
EXPLORED = list(without(_SETS["all"], _SETS["vol"]))
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _value(df, digits=6):
    return df.withColumn("value", r("value", digits))


def pearson_sql(source: str, cols, digits: int = 6) -> str:
    """All coefficients in one pass over ``source``, then a row for each."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    value = lambda i, j: f'CASE WHEN var_pop("{cols[i]}") > 0 THEN 1.0 END' if i == j else f'corr("{cols[i]}", "{cols[j]}")'
    values = ", ".join(value(i, j) for i, j in pairs)
    names = [", ".join(f"'{cols[p[k]]}'" for p in pairs) for k in (0, 1)]
    return f"""SELECT col_i, col_j, round(value, {digits}) + 0.0 AS value FROM (
        SELECT unnest([{names[0]}]) AS col_i, unnest([{names[1]}]) AS col_j, unnest([{values}]) AS value FROM {source})"""


QUERIES["r1_pearson_lineitem"] = lambda s, d: _value(correlation.pearson(table(s, d, "lineitem"), LINE))
ORACLES["r1_pearson_lineitem"] = pearson_sql("lineitem", LINE)
QUERIES["r1_pearson_panel"] = lambda s, d: _value(correlation.pearson(feature_frame(s, d), EXPLORED))
ORACLES["r1_pearson_panel"] = FEATURES + " " + pearson_sql("features", EXPLORED)


def ranks_sql(source: str, cols, cte: str = "ranked") -> str:
    ranked = ", ".join(
        f'rank() OVER (ORDER BY "{c}") + (count(*) OVER (PARTITION BY "{c}") - 1) / 2.0 AS "{c}"' for c in cols
    )
    return f"{cte} AS (SELECT {ranked} FROM {source})"


# embeddings: a row per vector and coordinate, the label as one more
LONG = """long AS MATERIALIZED (SELECT vec_id, unnest(list_append(list_transform(embedding, lambda v: v::DOUBLE), label::DOUBLE)) AS x,
        generate_subscripts(list_append(embedding, 0), 1) AS c FROM embeddings),
    names AS (SELECT c, CASE WHEN c > 64 THEN 'label' ELSE 'x' || c END AS name FROM range(1, 66) AS t(c))"""
NAMED = "JOIN names a ON a.c = i JOIN names b ON b.c = j"

QUERIES["r2_spearman_embeddings"] = lambda s, d: _value(correlation.spearman(points(s, d), [*XS, "label"], "vec_id"))
ORACLES["r2_spearman_embeddings"] = f"""WITH {LONG}, ranked AS MATERIALIZED (
        SELECT vec_id, c, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS r FROM long),
    found AS (SELECT p.c AS i, q.c AS j, corr(p.r, q.r) AS value FROM ranked p JOIN ranked q USING (vec_id) GROUP BY ALL)
    SELECT a.name AS col_i, b.name AS col_j, round(CASE WHEN i = j THEN 1.0 ELSE value END, 6) + 0.0 AS value FROM found {NAMED}"""
ORDER = ["o_totalprice", "o_custkey", "o_orderkey"]
QUERIES["r2_spearman_orders_split"] = lambda s, d: _value(
    correlation.spearman(table(s, d, "orders"), ORDER, "o_orderkey", rows_per_bucket=1_000)
)
ORACLES["r2_spearman_orders_split"] = f"WITH {ranks_sql('orders', ORDER)} {pearson_sql('ranked', ORDER)}"
PART = ["p_size", "p_retailprice", "p_partkey"]
QUERIES["r2_spearman_part"] = lambda s, d: _value(correlation.spearman(table(s, d, "part"), PART, "p_partkey"))
ORACLES["r2_spearman_part"] = f"WITH {ranks_sql('part', PART)} {pearson_sql('ranked', PART)}"


def kendall_sql(source: str, cols) -> str:
    sums = ", ".join(
        f'sum(sign(CAST(a."{x}" AS DOUBLE) - b."{x}") * sign(CAST(a."{y}" AS DOUBLE) - b."{y}")) AS s_{i}_{j}'
        for i, x in enumerate(cols)
        for j, y in enumerate(cols)
        if i <= j
    )
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS col_i, '{y}' AS col_j, round(s_{min(i, j)}_{max(i, j)} / (sqrt(s_{i}_{i}) * sqrt(s_{j}_{j})), 6) + 0.0 AS value FROM sums"
        for i, x in enumerate(cols)
        for j, y in enumerate(cols)
    )
    return f"sums AS (SELECT {sums} FROM {source} a CROSS JOIN {source} b) {rows}"


QUERIES["r3_kendall_embeddings"] = lambda s, d: _value(correlation.kendall(points(s, d), [*XS, "label"]))
CUST = ["c_custkey", "c_nationkey", "c_acctbal"]
QUERIES["r3_kendall_customer"] = lambda s, d: _value(correlation.kendall(table(s, d, "customer"), CUST))
ORACLES["r3_kendall_customer"] = f"WITH {kendall_sql('customer', CUST)}"


def dcor_sql(source: str, key: str, cols, digits: int = 6) -> str:
    """Doubly centred distances over every row pair."""
    dist = ", ".join(f'abs(CAST(a."{c}" AS DOUBLE) - b."{c}") AS d{i}' for i, c in enumerate(cols))
    centred = ", ".join(
        f"d{i} - avg(d{i}) OVER (PARTITION BY a) - avg(d{i}) OVER (PARTITION BY b) + avg(d{i}) OVER () AS c{i}" for i in range(len(cols))
    )
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i <= j]
    sums = ", ".join(f"avg(c{i} * c{j}) AS v_{i}_{j}" for i, j in pairs)
    rows = []
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            a, b = min(i, j), max(i, j)
            v = "1.0" if i == j else f"sqrt(greatest(v_{a}_{b} / sqrt(v_{i}_{i} * v_{j}_{j}), 0.0))"
            rows.append(f"SELECT '{x}' AS col_i, '{y}' AS col_j, round({v}, {digits}) + 0.0 AS value FROM dsums")
    return f"""dist AS (SELECT a.{key} AS a, b.{key} AS b, {dist} FROM {source} a CROSS JOIN {source} b),
    cent AS (SELECT {centred} FROM dist), dsums AS (SELECT {sums} FROM cent) {' UNION ALL '.join(rows)}"""


QUERIES["r4_distance_correlation_embeddings"] = lambda s, d: _value(
    correlation.distance_correlation(points(s, d), XS, "vec_id")
)
QUERIES["r4_distance_correlation_customer"] = lambda s, d: _value(
    correlation.distance_correlation(table(s, d, "customer"), CUST, "c_custkey")
)
ORACLES["r4_distance_correlation_customer"] = f"WITH {dcor_sql('customer', 'c_custkey', CUST)}"

QUERIES["r5_variance_lineitem"] = lambda s, d: correlation.variance_vector(table(s, d, "lineitem"), LINE)
ORACLES["r5_variance_lineitem"] = f"""SELECT "column", round_even(var_samp(value), 2) + 0.0 AS variance
    FROM ({long_sql("lineitem", LINE)}) GROUP BY "column" """

# --- plot data ----------------------------------------------------------------
QUERIES["r6_histogram_lineitem"] = lambda s, d: density.histogram(table(s, d, "lineitem"), ["l_extendedprice", "l_tax"], 20).select(
    "column", "bin", r("low", 4).alias("low"), r("high", 4).alias("high"), "count"
)
ORACLES["r6_histogram_lineitem"] = f"""WITH v AS ({long_sql("lineitem", ["l_extendedprice", "l_tax"])}),
    lim AS (SELECT "column", min(value) AS a, max(value) AS b FROM v GROUP BY "column"),
    binned AS (SELECT v."column", a, (b - a) / 20 AS w,
        CAST(least(floor((value - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin FROM v JOIN lim USING ("column"))
    SELECT "column", bin, round(a + bin * w, 4) + 0.0 AS low, round(a + bin * w + w, 4) + 0.0 AS high, count(*) AS count
    FROM binned GROUP BY "column", bin, a, w"""
QUERIES["r6_density_curve_events"] = lambda s, d: density.density_curve(table(s, d, "events"), ["value"]).select(
    "column", "point", r("x", 4).alias("x"), r("density", 8).alias("density")
)
ORACLES["r6_density_curve_events"] = """WITH st AS (SELECT count(value) AS n, min(value) AS a, max(value) AS b,
      stddev_samp(value) * power(CAST(count(value) AS DOUBLE), -0.2) AS h FROM events),
    grid AS (SELECT CAST(i AS INTEGER) AS point, (a - 3 * h) + i * ((b + 3 * h) - (a - 3 * h)) / 199 AS x, h, n
             FROM st, (SELECT unnest(range(200)) AS i))
    SELECT 'value' AS "column", point, round(x, 4) + 0.0 AS x,
      round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (max(n) * max(h) * sqrt(2 * pi())), 8) + 0.0 AS density
    FROM grid, events GROUP BY point, x"""
QUERIES["r6_scatter_pairs_embeddings"] = lambda s, d: density.scatter_pairs(points(s, d), XS, "label", "vec_id", 0.5)
ORACLES["r6_scatter_pairs_embeddings"] = f"""WITH {LONG}, kept AS (SELECT vec_id FROM (
        SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE rn <= floor(CAST(0.5 AS DOUBLE) * n)),
    sampled AS MATERIALIZED (SELECT long.* FROM long JOIN kept USING (vec_id) WHERE c <= 64)
    SELECT vec_id, a.name AS x_col, b.name AS y_col, p.x AS x, q.x AS y FROM sampled p JOIN sampled q USING (vec_id)
    JOIN names a ON a.c = p.c JOIN names b ON b.c = q.c WHERE p.c < q.c"""

# --- matrix studies ----------------------------------------------------------
FLAGS = ["A", "N", "R"]


def _runs(s, d):
    """One Pearson matrix per return flag, as three runs."""
    lines = table(s, d, "lineitem")
    parts = [
        correlation.pearson(lines.where(F.col("l_returnflag") == f), LINE).select(F.lit(i + 1).alias("run"), "*")
        for i, f in enumerate(FLAGS)
    ]
    return reduce(DataFrame.unionAll, parts)


RUNS = "runs AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS run, * FROM ({pearson_sql(f'(SELECT * FROM lineitem WHERE l_returnflag = {chr(39)}{f}{chr(39)})', LINE, 12)})"
    for i, f in enumerate(FLAGS)
) + """),
norms AS (SELECT run, round_even(sum(CASE WHEN col_i <> col_j THEN abs(value) ELSE 0 END), 4) + 0.0 AS sum,
    round_even(sum(CASE WHEN col_i <> col_j THEN abs(value) ELSE 0 END) / count(*) FILTER (WHERE col_i <> col_j), 4) + 0.0 AS avg,
    round_even(sqrt(sum(value * value)), 4) + 0.0 AS fro FROM runs GROUP BY run)"""
QUERIES["k1_k2_matrix_norms"] = lambda s, d: matrices.matrix_norms(_runs(s, d), ["run"])
ORACLES["k1_k2_matrix_norms"] = f"WITH {RUNS} SELECT run, sum, avg, fro FROM norms".replace(
    "round_even(sum(CASE WHEN col_i <> col_j THEN abs(value) ELSE 0 END) / count",
    "round_even(round_even(sum(CASE WHEN col_i <> col_j THEN abs(value) ELSE 0 END), 4) / count",
)
QUERIES["k3_run_differences"] = lambda s, d: matrices.run_differences(matrices.matrix_norms(_runs(s, d), ["run"]))
ORACLES["k3_run_differences"] = f"""WITH {RUNS}
    SELECT a.run AS from_run, b.run AS to_run, round_even(b.fro - a.fro, 4) + 0.0 AS difference
    FROM norms a JOIN norms b ON a.run < b.run"""


def _two(s, d):
    cols = ["l_quantity", "l_extendedprice"]
    return matrices.eigenvalues(correlation.pearson(table(s, d, "lineitem"), cols), cols)


TWO = 'eig AS (SELECT 1 AS k, 1 + abs(corr(l_quantity, l_extendedprice)) AS v FROM lineitem UNION ALL SELECT 2, 1 - abs(corr(l_quantity, l_extendedprice)) FROM lineitem)'
QUERIES["k4_eigenvalues_two_columns"] = lambda s, d: _two(s, d).select("k", r("eigenvalue").alias("eigenvalue"))
ORACLES["k4_eigenvalues_two_columns"] = f"WITH {TWO} SELECT k, round(v, 6) + 0.0 AS eigenvalue FROM eig"
QUERIES["k4_eigenvalues_distance_panel"] = lambda s, d: matrices.eigenvalues(
    correlation.distance_correlation(feature_frame(s, d), EXPLORED, "row_id"), EXPLORED
)
QUERIES["k5_variance_explained"] = lambda s, d: matrices.variance_explained(_two(s, d)).select(
    "k", *[r(c).alias(c) for c in ("eigenvalue", "proportion", "cumulative")]
)
ORACLES["k5_variance_explained"] = f"""WITH {TWO} SELECT k, round(v, 6) + 0.0 AS eigenvalue,
    round(v / sum(v) OVER (), 6) + 0.0 AS proportion, round(sum(v) OVER (ORDER BY k) / sum(v) OVER (), 6) + 0.0 AS cumulative FROM eig"""
QUERIES["r7_exploration_panel"] = lambda s, d: _explored(s, d)


def _explored(s, d):
    """All correlation matrices of the four stages of a stats run on the whole panel."""
    from ..operators.outliers import outlier_chain
    from ..plans.stats import explore_stages, shape_rounds

    settings, store = StudySettings(fraction=1.0), scratch_store(s, "r7")
    raw = store.stage(STAGES[0], lambda: feature_frame(s, d))
    kept = store.stage(STAGES[1], lambda: outlier_chain(raw, CONTINUOUS, "row_id", settings))
    shape_rounds(kept, CONTINUOUS, "Sector 1", "row_id", settings, store)
    return explore_stages(store, STAGES, EXPLORED, "Sector 1", "row_id", settings.fraction, plots=False)
