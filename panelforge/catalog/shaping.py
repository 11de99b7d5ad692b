"""Transform and shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONTINUOUS, STAGES, StudySettings
from ..functions import shape as fx
from ..functions.scalars import col
from ..operators import power, shape
from .common import feature_frame, long_sql, r, scratch_store, table
from .panel_sql import FEATURES

QUERIES: dict = {}
ORACLES: dict = {}

EPS = "CAST(1e-8 AS DOUBLE)"
PLAIN_SQL = {
    "sqrt": "CASE WHEN {x} IS NULL THEN NULL ELSE sqrt(greatest({x}, 0.0)) END",
    "inv_sqrt": f"CASE WHEN {{x}} + {EPS} > 0 THEN 1.0 / sqrt({{x}} + {EPS}) END",
    "inv": f"CASE WHEN {{x}} + {EPS} <> 0 THEN 1.0 / ({{x}} + {EPS}) END",
}


def yj_sql(x: str, lam: str) -> str:
    """Yeo-Johnson with lambda given as SQL; NULL where the exponential would overflow."""
    up, down, rest = f"ln(1.0 + greatest({x}, 0.0))", f"ln(1.0 + greatest(-({x}), 0.0))", f"(2.0 - {lam})"
    return f"""CASE WHEN {x} >= 0 THEN CASE WHEN {lam} = 0 THEN {up} WHEN {lam} * {up} < 700 THEN (exp({lam} * {up}) - 1.0) / {lam} END
        ELSE CASE WHEN {rest} = 0 THEN -{down} WHEN {rest} * {down} < 700 THEN -(exp({rest} * {down}) - 1.0) / {rest} END END"""


QUERIES["t1_sqrt_customer"] = lambda s, d: table(s, d, "customer").select("c_custkey", r(fx.clipped_sqrt(F.col("c_acctbal"))).alias("y"))
QUERIES["t2_inverse_sqrt_customer"] = lambda s, d: table(s, d, "customer").select("c_custkey", r(fx.inverse_sqrt(F.col("c_acctbal"))).alias("y"))
QUERIES["t3_inverse_customer"] = lambda s, d: table(s, d, "customer").select("c_custkey", r(fx.inverse(F.col("c_acctbal"))).alias("y"))
for _key, _name in (("t1_sqrt_customer", "sqrt"), ("t2_inverse_sqrt_customer", "inv_sqrt"), ("t3_inverse_customer", "inv")):
    ORACLES[_key] = f"SELECT c_custkey, round({PLAIN_SQL[_name].format(x='c_acctbal')}, 6) + 0.0 AS y FROM customer"

LAMBDA = 0.25
QUERIES["t4_power_applied_customer"] = lambda s, d: power.apply_power(
    table(s, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": LAMBDA}
).select("c_custkey", r("c_acctbal").alias("y"))
ORACLES["t4_power_applied_customer"] = f"""WITH p AS (SELECT c_custkey, {yj_sql('c_acctbal', str(LAMBDA))} AS y FROM customer)
    SELECT c_custkey, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) + 0.0 AS y FROM p"""

GRID = [i / 4 for i in range(-8, 9)]


def _grid_fit(df, cols, method="yeo-johnson"):
    return power.best_lambda(power.score_lambdas(df, {c: GRID for c in cols}, method)).select("column", "lam")


def _grid_sql(long: str, value: str, jac: str, grid) -> str:
    values = ", ".join(f"CAST({g} AS DOUBLE)" for g in grid)
    return f"""SELECT "column", lam FROM (
        SELECT "column", lam, row_number() OVER (PARTITION BY "column" ORDER BY score DESC NULLS LAST, lam) AS rn FROM (
          SELECT "column", lam, CASE WHEN bool_or(y IS NULL) OR var_pop(y) <= 0 THEN NULL
                 ELSE count(*) * -0.5 * ln(var_pop(y)) + (lam - 1) * sum(j) END AS score
          FROM (SELECT "column", lam, {value} AS y, {jac} AS j FROM ({long}) v, (SELECT unnest([{values}]) AS lam) g)
          GROUP BY "column", lam)) WHERE rn = 1"""


YJ_JAC = "sign(value) * ln(1.0 + abs(value))"


def refined_sql(long: str, value: str, jac: str) -> str:
    """CTE chain ending in ``fitted(column, lam)``: the coarse grid, then brackets around the best value, each a tenth as wide."""
    last = power.REFINE_POINTS - 1
    coarse = ", ".join(f"CAST({g} AS DOUBLE)" for g in power.COARSE_GRID)
    steps = [f"""vals0 AS MATERIALIZED ({long}),
    g0 AS (SELECT "column", i - 1 AS i, lam FROM (SELECT DISTINCT "column" FROM vals0),
        (SELECT unnest([{coarse}]) AS lam, generate_subscripts([{coarse}], 1) AS i))"""]
    for k in range(power.REFINEMENTS + 1):
        steps.append(f"""f{k} AS MATERIALIZED (SELECT "column", lam, i FROM (
        SELECT "column", lam, i, row_number() OVER (PARTITION BY "column" ORDER BY score DESC NULLS LAST, lam) AS rn FROM (
          SELECT "column", i, lam, CASE WHEN bool_or(y IS NULL) OR var_pop(y) <= 0 THEN NULL
                 ELSE count(*) * -0.5 * ln(var_pop(y)) + (lam - 1) * sum(j) END AS score
          FROM (SELECT "column", i, lam, {value} AS y, {jac} AS j FROM vals0 JOIN g{k} USING ("column") WHERE value IS NOT NULL)
          GROUP BY "column", i, lam)) WHERE rn = 1)""")
        if k < power.REFINEMENTS:
            top = len(power.COARSE_GRID) - 1 if k == 0 else last
            steps.append(f"""g{k + 1} AS MATERIALIZED (SELECT "column", n AS i, lo.lam + n * ((hi.lam - lo.lam) / {last}) AS lam
        FROM f{k} f JOIN g{k} lo USING ("column") JOIN g{k} hi USING ("column"), range({last + 1}) AS t(n)
        WHERE lo.i = greatest(f.i - 1, 0) AND hi.i = least(f.i + 1, {top}))""")
    steps.append(f'fitted AS MATERIALIZED (SELECT "column", lam FROM f{power.REFINEMENTS})')
    return ",\n    ".join(steps)


QUERIES["t4_power_grid_fit_lineitem"] = lambda s, d: _grid_fit(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
ORACLES["t4_power_grid_fit_lineitem"] = _grid_sql(
    long_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), yj_sql("value", "lam"), YJ_JAC, GRID
)
QUERIES["t5_box_cox_grid_fit_events"] = lambda s, d: _grid_fit(table(s, d, "events").where("value > 0"), ["value"], "box-cox")
ORACLES["t5_box_cox_grid_fit_events"] = _grid_sql(
    "SELECT 'value' AS \"column\", value FROM events WHERE value > 0",
    "CASE WHEN lam = 0 THEN ln(value) ELSE (exp(lam * ln(value)) - 1.0) / lam END",
    "ln(value)",
    GRID,
)


def _fitted(df, method="yeo-johnson"):
    rows = sorted(power.fit_power(df, ["value"], method).items())
    return df.sparkSession.createDataFrame([(c, round(v, 2)) for c, v in rows], "column string, lam double")


BOX_COX = "CASE WHEN lam = 0 THEN ln(value) WHEN lam * ln(value) < 700 THEN (exp(lam * ln(value)) - 1.0) / lam END"
FITTED = 'SELECT "column", round(lam, 2) + 0.0 AS lam FROM fitted'
QUERIES["t4_power_refined_fit_events"] = lambda s, d: _fitted(table(s, d, "events"))
ORACLES["t4_power_refined_fit_events"] = f"WITH {refined_sql(long_sql('events', ['value']), yj_sql('value', 'lam'), YJ_JAC)} {FITTED}"
QUERIES["t5_box_cox_refined_fit_events"] = lambda s, d: _fitted(table(s, d, "events").where("value > 0"), "box-cox")
ORACLES["t5_box_cox_refined_fit_events"] = (
    f"""WITH {refined_sql("SELECT 'value' AS \"column\", value FROM events WHERE value > 0", BOX_COX, "ln(value)")} {FITTED}"""
)


# --- moments ------------------------------------------------------------------
def _moments_sql(long: str, keys: str, skew: str, kurt: str, digits: int | None = None) -> str:
    on = " AND ".join(f"t.{k} = m.{k}" for k in keys.split(", "))
    each = ", ".join(f"t.{k}" for k in keys.split(", "))
    s = "avg(power(y - mu, 3)) / nullif(power(avg((y - mu) * (y - mu)), 1.5), 0)"
    k = "avg(power(y - mu, 4)) / nullif(power(avg((y - mu) * (y - mu)), 2), 0) - 3"
    if digits is not None:
        s, k = f"round_even({s}, {digits}) + 0.0", f"round_even({k}, {digits}) + 0.0"
    return f"""SELECT {each}, {s} AS {skew}, {k} AS {kurt} FROM ({long}) t
        JOIN (SELECT {keys}, avg(y) AS mu FROM ({long}) GROUP BY {keys}) m ON {on} GROUP BY {each}"""


MOMENT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES["d1_d2_skew_kurtosis_lineitem"] = lambda s, d: shape.moments(table(s, d, "lineitem"), MOMENT_COLS, 4)
ORACLES["d1_d2_skew_kurtosis_lineitem"] = _moments_sql(
    long_sql("lineitem", MOMENT_COLS).replace("AS value", "AS y"), '"column"', "skew", "kurt", 4
)
QUERIES["d1_d2_skew_kurtosis_documents"] = lambda s, d: shape.moments(table(s, d, "documents"), ["n_chars"], 4)
ORACLES["d1_d2_skew_kurtosis_documents"] = _moments_sql(
    long_sql("documents", ["n_chars"]).replace("AS value", "AS y"), '"column"', "skew", "kurt", 4
)


def report_sql(long: str, power_value: str | None = None) -> str:
    """CTEs ending in ``report(column, transform, skew_before, skew_after, kurt_before, kurt_after)``."""
    names = dict(PLAIN_SQL)
    if power_value:
        names["power"] = power_value
    rows = " UNION ALL ".join(
        f"SELECT \"column\", '{t}' AS transform, {sql.format(x='value')} AS y, value FROM vals" for t, sql in names.items()
    )
    return f"""vals AS ({long}),
    shaped AS (SELECT "column", transform, y FROM ({rows}) WHERE y IS NOT NULL),
    before AS ({_moments_sql('SELECT "column", value AS y FROM vals WHERE value IS NOT NULL', '"column"', 'skew_before', 'kurt_before', 2)}),
    after AS ({_moments_sql('SELECT * FROM shaped', '"column", transform', 'skew_after', 'kurt_after', 2)}),
    poles AS (SELECT "column", count(*) FILTER (WHERE value + {EPS} = 0) AS n FROM vals GROUP BY "column"),
    report AS (SELECT before."column", transform, skew_before,
        CASE WHEN n = 0 OR transform NOT IN ('inv', 'inv_sqrt') THEN skew_after END AS skew_after, kurt_before,
        CASE WHEN n = 0 OR transform NOT IN ('inv', 'inv_sqrt') THEN kurt_after END AS kurt_after
        FROM before JOIN after USING ("column") JOIN poles USING ("column"))"""


REPORT = 'SELECT "column", transform, skew_before, skew_after, kurt_before, kurt_after FROM report'
PLAIN = fx.TransformRegistry(include_power=False)
QUERIES["d3_shape_report_lineitem"] = lambda s, d: shape.shape_report(table(s, d, "lineitem"), MOMENT_COLS, None, PLAIN)
ORACLES["d3_shape_report_lineitem"] = f"WITH {report_sql(long_sql('lineitem', MOMENT_COLS))} {REPORT}"
QUERIES["d3_shape_report_events"] = lambda s, d: shape.shape_report(
    table(s, d, "events"), ["value"], {"value": LAMBDA}
)
ORACLES["d3_shape_report_events"] = f"WITH {report_sql(long_sql('events', ['value']), yj_sql('value', str(LAMBDA)))} {REPORT}"


def _report(s, d):
    """Whole panel, fitted power lambdas."""
    df = shape_input(s, d)
    return shape.shape_report(df, CONTINUOUS, power.fit_power(df, CONTINUOUS))


def shape_input(s, d):
    from ..session import cut_lineage

    return cut_lineage(feature_frame(s, d).select("row_id", *[col(c) for c in CONTINUOUS]))


REPORT_SQL = FEATURES + f""",
    long AS ({long_sql('features', CONTINUOUS)}),
    {refined_sql('SELECT * FROM long', yj_sql('value', 'lam'), YJ_JAC)},
    withlam AS (SELECT "column", value, lam FROM long JOIN fitted USING ("column")),
    {report_sql('SELECT "column", value, lam FROM withlam', yj_sql('value', 'lam'))}"""
QUERIES["d4_shape_analysis_panel"] = _report
ORACLES["d4_shape_analysis_panel"] = REPORT_SQL + " " + REPORT

TABLE = 'SELECT "column", transform, skew_after AS skew, kurt_after AS kurt FROM report'
QUERIES["d5_transform_table_lineitem"] = lambda s, d: shape.transform_table(
    shape.shape_report(table(s, d, "lineitem"), MOMENT_COLS, None, PLAIN)
)
ORACLES["d5_transform_table_lineitem"] = f"WITH {report_sql(long_sql('lineitem', MOMENT_COLS))} {TABLE}"

BEST = """best AS (SELECT "column", transform, skew, kurt FROM (
    SELECT "column", transform, skew_after AS skew, kurt_after AS kurt, row_number() OVER (PARTITION BY "column"
      ORDER BY abs(skew_after) + abs(kurt_after), list_position(['sqrt', 'inv_sqrt', 'inv', 'power'], transform)) AS rn
    FROM report WHERE skew_after IS NOT NULL AND kurt_after IS NOT NULL) WHERE rn = 1)"""
QUERIES["d6_optimal_transform_panel"] = lambda s, d: shape.optimal_transforms(shape.transform_table(_report(s, d)))
ORACLES["d6_optimal_transform_panel"] = REPORT_SQL + ", " + BEST + ' SELECT "column", transform, skew, kurt FROM best'
QUERIES["d7_transform_map_lineitem"] = lambda s, d: shape.optimal_transforms(
    shape.transform_table(shape.shape_report(table(s, d, "lineitem"), MOMENT_COLS, None, PLAIN)), PLAIN.names()
)
ORACLES["d7_transform_map_lineitem"] = (
    f"WITH {report_sql(long_sql('lineitem', MOMENT_COLS))}, {BEST} SELECT \"column\", transform, skew, kurt FROM best"
)
QUERIES["d8_above_threshold_panel"] = lambda s, d: shape.above_threshold(
    shape.optimal_transforms(shape.transform_table(_report(s, d))), 0.25
)
ORACLES["d8_above_threshold_panel"] = (
    REPORT_SQL + ", " + BEST + ' SELECT "column", transform, skew, kurt FROM best WHERE (abs(skew) + abs(kurt)) / 2 >= 0.25'
)

CHOSEN = {"l_quantity": "sqrt", "l_extendedprice": "inv", "l_discount": "sqrt", "l_tax": "unknown"}
QUERIES["d9_apply_transforms_lineitem"] = lambda s, d: shape.reshape_columns(
    table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *MOMENT_COLS), CHOSEN
).select("l_orderkey", "l_linenumber", *[r(c, 8).alias(c) for c in MOMENT_COLS])
ORACLES["d9_apply_transforms_lineitem"] = f"""SELECT l_orderkey, l_linenumber,
    round({PLAIN_SQL['sqrt'].format(x='l_quantity')}, 8) + 0.0 AS l_quantity,
    round({PLAIN_SQL['inv'].format(x='l_extendedprice')}, 8) + 0.0 AS l_extendedprice,
    round({PLAIN_SQL['sqrt'].format(x='l_discount')}, 8) + 0.0 AS l_discount,
    round(l_tax, 8) + 0.0 AS l_tax FROM lineitem"""


def _audit(s, d):
    before = table(s, d, "lineitem").select(*MOMENT_COLS)
    return shape.shape_audit(before, shape.reshape_columns(before, CHOSEN), MOMENT_COLS)


def _audit_sql() -> str:
    inner = f"""SELECT {PLAIN_SQL['sqrt'].format(x='l_quantity')} AS l_quantity, {PLAIN_SQL['inv'].format(x='l_extendedprice')} AS l_extendedprice,
        {PLAIN_SQL['sqrt'].format(x='l_discount')} AS l_discount, l_tax FROM lineitem"""
    parts = []
    for phase, source in (("before", "lineitem"), ("after", "changed")):
        m = _moments_sql(long_sql(source, MOMENT_COLS).replace("AS value", "AS y"), '"column"', "skew", "kurt")
        parts.append(f"SELECT '{phase}' AS phase, round_even(avg(skew), 2) + 0.0 AS mean_skew, round_even(avg(kurt), 2) + 0.0 AS mean_kurt FROM ({m})")
    return f"WITH changed AS ({inner}) {' UNION ALL '.join(parts)}"


QUERIES["d10_mean_shape_audit_lineitem"] = _audit
ORACLES["d10_mean_shape_audit_lineitem"] = _audit_sql()


def _rounds(s, d):
    """Two rounds of analyse, choose, apply on the whole panel; the chosen transforms of each."""
    from functools import reduce

    from ..plans.stats import shape_rounds

    settings, store = StudySettings(fraction=1.0), scratch_store(s, "d11")
    df = feature_frame(s, d).select("row_id", "`Sector 1`", *[col(c) for c in CONTINUOUS])
    shape_rounds(store.save(df, STAGES[1]), CONTINUOUS, "Sector 1", "row_id", settings, store)
    maps = [store.load(f"transform_map{i}").select(F.lit(i).alias("round"), "*") for i in range(1, settings.shapes.rounds + 1)]
    return reduce(lambda a, b: a.unionAll(b), maps)


QUERIES["d11_two_rounds_panel"] = _rounds
