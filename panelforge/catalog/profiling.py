"""Sampling, profiling and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import col
from ..operators import clean, profile, sampling
from ..sources.panel import company_panel
from .common import cleaned_panel, long_sql, r, rounded, table
from .panel_sql import CLEANED, PANEL

QUERIES: dict = {}
ORACLES: dict = {}

TYPES = {
    "lineitem": dict(
        l_orderkey="bigint",
        l_partkey="bigint",
        l_suppkey="bigint",
        l_linenumber="int",
        l_quantity="double",
        l_extendedprice="double",
        l_discount="double",
        l_tax="double",
        l_returnflag="string",
        l_linestatus="string",
        l_shipdate="timestamp_ntz",
    ),
    "conversations": dict(conv_id="bigint", turn="bigint", role="string", text="string"),
    "pages": dict(page_id="bigint", url="string", html="string"),
}


def _quality_sql(name: str) -> str:
    parts = []
    for c, t in TYPES[name].items():
        zero = f"count(*) FILTER (WHERE {c} = 0)" if t in ("bigint", "int", "double") else "0"
        parts.append(
            f"""SELECT '{c}' AS "column", '{t}' AS data_type, CAST(count(*) AS BIGINT) AS total,
                CAST({zero} AS BIGINT) AS zero_count, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
                CAST(count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count,
                CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM {name}"""
        )
    pct = lambda c: f"round_even(CAST({c} AS DOUBLE) / total * 100.0, 2) AS {c.replace('_count', '_percentage')}"
    counts = ["zero_count", "missing_count", "duplicate_count", "unique_count"]
    return f"""SELECT "column", data_type, {', '.join(counts)}, {', '.join(pct(c) for c in counts)}
        FROM ({' UNION ALL '.join(parts)})"""


for _name in TYPES:
    QUERIES[f"q1_quality_report_{_name}"] = lambda s, d, n=_name: profile.quality_report(table(s, d, n))
    ORACLES[f"q1_quality_report_{_name}"] = _quality_sql(_name)

DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES["q2_describe_lineitem"] = lambda s, d: profile.describe(table(s, d, "lineitem"), DESCRIBED)
ORACLES["q2_describe_lineitem"] = f"""
    SELECT "column", count(value) AS count, round_even(avg(value), 2) AS mean, round_even(stddev_samp(value), 2) AS std,
           round_even(min(value), 2) AS min, round_even(quantile_cont(value, 0.25), 2) AS q25,
           round_even(quantile_cont(value, 0.5), 2) AS q50, round_even(quantile_cont(value, 0.75), 2) AS q75,
           round_even(max(value), 2) AS max
    FROM ({long_sql("lineitem", DESCRIBED)}) GROUP BY "column" """


def _shape_audit(s, d):
    panel = company_panel(s, d)
    complete = clean.drop_missing(clean.drop_if_present(panel, "No"))
    return profile.shape_audit({"panel": panel, "complete": complete})


QUERIES["q4_shape_audit_panel"] = _shape_audit
ORACLES["q4_shape_audit_panel"] = (
    CLEANED
    + """ SELECT 0 AS step, 'panel' AS stage, CAST(count(*) AS BIGINT) AS n_rows, 50 AS n_cols FROM panel
          UNION ALL SELECT 1, 'complete', CAST(count(*) AS BIGINT), 49 FROM cleaned"""
)


# --- sampling ---------------------------------------------------------------
def _sample_sql(source: str, stratum: str, key: str, fraction: float, cols: str) -> str:
    return f"""SELECT {cols} FROM (
        SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(CAST({key} AS VARCHAR) || '|42'), {key}) AS rn,
               count(*) OVER (PARTITION BY {stratum}) AS n
        FROM {source} WHERE {stratum} IS NOT NULL) WHERE rn <= floor(CAST({fraction} AS DOUBLE) * n)"""


QUERIES["p1_stratified_sample_orders"] = lambda s, d: sampling.stratified_sample(
    table(s, d, "orders"), "o_orderpriority", "o_orderkey"
).select("o_orderkey", "o_orderpriority", "o_totalprice")
ORACLES["p1_stratified_sample_orders"] = _sample_sql(
    "orders", "o_orderpriority", "o_orderkey", 0.1, "o_orderkey, o_orderpriority, o_totalprice"
)
QUERIES["p1_stratified_sample_documents"] = lambda s, d: sampling.stratified_sample(
    table(s, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", 0.25
)
ORACLES["p1_stratified_sample_documents"] = _sample_sql("documents", "source", "doc_id", 0.25, "doc_id, source, n_chars")


def _twice(s, d):
    first = sampling.stratified_sample(table(s, d, "orders"), "o_orderpriority", "o_orderkey")
    again = sampling.stratified_sample(first, "o_orderpriority", "o_orderkey", seed=7)
    return again.select("o_orderkey", "o_orderpriority")


QUERIES["p2_sample_of_sample_orders"] = _twice
ORACLES["p2_sample_of_sample_orders"] = f"""
    WITH first AS ({_sample_sql("orders", "o_orderpriority", "o_orderkey", 0.1, "o_orderkey, o_orderpriority")})
    {_sample_sql("first", "o_orderpriority", "o_orderkey", 0.1, "o_orderkey, o_orderpriority").replace("'|42'", "'|7'")}"""

# --- cleaning ---------------------------------------------------------------
QUERIES["c1_drop_if_present_panel"] = lambda s, d: clean.drop_if_present(company_panel(s, d), "No", "absent").select(
    "row_id", col("Company name"), "Region", "Country", r(col("TAsset.2020"), 2).alias("assets_2020"),
    col("MScore.2020").alias("rating_2020"),
)
ORACLES["c1_drop_if_present_panel"] = (
    PANEL
    + """ SELECT row_id, "Company name", "Region", "Country", round("TAsset.2020", 2) AS assets_2020,
          "MScore.2020" AS rating_2020 FROM panel"""
)
QUERIES["c2_drop_missing_panel"] = lambda s, d: clean.drop_missing(company_panel(s, d)).select(
    "row_id", r(col("ROE.2020")).alias("roe_2020"), r(col("PLTax.2015"), 2).alias("pltax_2015")
)
ORACLES["c2_drop_missing_panel"] = (
    CLEANED + """ SELECT row_id, round("ROE.2020", 6) AS roe_2020, round("PLTax.2015", 2) AS pltax_2015 FROM cleaned"""
)
QUERIES["c3_keep_first_turn"] = lambda s, d: clean.keep_first(table(s, d, "conversations"), "conv_id", "turn")
ORACLES["c3_keep_first_turn"] = """SELECT conv_id, turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1"""


def _doubled(s, d):
    """Every company twice, the copy later and the first one incomplete for odd keys."""
    panel = company_panel(s, d).select("row_id", "No", col("Company name"), col("EBIT.2020"), col("EBIT.2019"))
    broken = panel.withColumn("EBIT.2020", F.when(F.col("row_id") % 2 == 0, col("EBIT.2020")))
    copy = panel.withColumn("row_id", F.col("row_id") + 1_000_000_000)
    kept = clean.remove_rows(broken.unionByName(copy))
    return kept.select("row_id", col("Company name"), r(col("EBIT.2020"), 2).alias("ebit_2020"))


QUERIES["c3_keep_first_complete_company"] = _doubled
ORACLES["c3_keep_first_complete_company"] = (
    PANEL
    + """ SELECT CASE WHEN row_id % 2 = 0 THEN row_id ELSE row_id + 1000000000 END AS row_id, "Company name",
          round("EBIT.2020", 2) AS ebit_2020 FROM panel WHERE "EBIT.2020" IS NOT NULL AND "EBIT.2019" IS NOT NULL"""
)

RATINGS = [f"MScore.{y}" for y in ("2020", "2019", "2018", "2017", "2016", "2015")]


def _mapped(s, d):
    mapped = clean.map_values(company_panel(s, d), clean.rating_maps(), unmapped="error")
    return mapped.select("row_id", "Country", *[col(c).alias(c.replace(".", "_")) for c in RATINGS])


def _rating_case(c: str) -> str:
    return f"""CASE WHEN "{c}" IN ('AAA', 'AA', 'A') THEN 0 WHEN "{c}" IN ('BBB', 'BB', 'B') THEN 1
        WHEN "{c}" IN ('CCC', 'CC', 'C') THEN 2 WHEN "{c}" = 'D' THEN 3 END AS {c.replace('.', '_')}"""


QUERIES["c4_map_categories_panel"] = _mapped
ORACLES["c4_map_categories_panel"] = (
    PANEL
    + f""" SELECT row_id, CASE "Country" WHEN 'Italy' THEN 0 WHEN 'France' THEN 1 WHEN 'Spain' THEN 2
           WHEN 'Germany' THEN 3 END AS "Country", {', '.join(map(_rating_case, RATINGS))} FROM panel"""
)


def _keyed(s, d):
    return clean.composite_key(table(s, d, "part"), "brand_type", ["p_brand", "p_type"])


QUERIES["c5_composite_key_part"] = lambda s, d: _keyed(s, d).select("p_partkey", "brand_type")
ORACLES["c5_composite_key_part"] = "SELECT p_partkey, p_brand || '_' || p_type AS brand_type FROM part"
QUERIES["c6_label_encode_part"] = lambda s, d: clean.label_encode(_keyed(s, d), "brand_type")[0].select(
    "p_partkey", "brand_type"
)
ORACLES["c6_label_encode_part"] = """SELECT p_partkey,
    dense_rank() OVER (ORDER BY p_brand || '_' || p_type) - 1 AS brand_type FROM part"""
QUERIES["c6_label_encode_document_source"] = lambda s, d: clean.label_encode(
    table(s, d, "documents").select("doc_id", "source"), "source"
)[0]
ORACLES["c6_label_encode_document_source"] = (
    "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS source FROM documents"
)
QUERIES["c7_category_codes_part"] = lambda s, d: clean.category_codes(_keyed(s, d), "brand_type")
ORACLES["c7_category_codes_part"] = """SELECT category, row_number() OVER (ORDER BY category) - 1 AS code
    FROM (SELECT DISTINCT p_brand || '_' || p_type AS category FROM part)"""

SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES["c9_standard_scale_lineitem"] = lambda s, d: rounded(
    clean.standard_scale(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *SCALED), SCALED), SCALED
)
ORACLES["c9_standard_scale_lineitem"] = f"""SELECT l_orderkey, l_linenumber, {', '.join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in SCALED)} FROM lineitem"""
QUERIES["c10_replace_values_embeddings"] = lambda s, d: clean.replace_values(
    table(s, d, "embeddings").select("vec_id", "label"), "label", {0: 1, 2: 0, 1: 2, 3: 3}
)
ORACLES["c10_replace_values_embeddings"] = """SELECT vec_id, CAST(CASE label WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 1 THEN 2
    ELSE label END AS INTEGER) AS label FROM embeddings"""


def _cleaned(s, d):
    return cleaned_panel(s, d).select(
        "row_id", "Country", "Combined_Sector", *[col(c).alias(c.replace(".", "_")) for c in RATINGS]
    )


QUERIES["c1_to_c7_cleaned_panel"] = _cleaned
ORACLES["c1_to_c7_cleaned_panel"] = (
    CLEANED
    + f""" SELECT row_id, "Country", "Combined_Sector", {', '.join(f'"{c}" AS {c.replace(".", "_")}' for c in RATINGS)}
           FROM cleaned"""
)
