"""Company-by-year panel derived from the order tables, one row per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import YEARS
from ..functions.scalars import col
from .tables import read_table

YEAR_SHIFT = 20

# fixed values: lower bound of EBIT / Turnover per rating, best first
RATING_FLOORS = (
    ("AAA", 0.5),
    ("AA", 0.4),
    ("A", 0.3),
    ("BBB", 0.2),
    ("BB", 0.1),
    ("B", 0.0),
    ("CCC", -0.25),
    ("CC", -0.75),
    ("C", -1.5),
)
COUNTRIES = ("Italy", "France", "Spain", "Germany")


def _rating(margin: Column) -> Column:
    rating = None
    for name, floor in RATING_FLOORS:
        test = margin >= F.lit(floor)
        rating = F.when(test, name) if rating is None else rating.when(test, name)
    return F.when(margin.isNotNull(), rating.otherwise("D"))


def company_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide panel with the columns the cleaning and feature steps expect."""
    first, last = int(min(YEARS)) - YEAR_SHIFT, int(max(YEARS)) - YEAR_SHIFT
    orders = read_table(spark, sf_dir, "orders")
    # literals of the column's own type, so the range reaches the Parquet scan
    date_type = orders.schema["o_orderdate"].dataType
    orders = (
        orders.where(
            (F.col("o_orderdate") >= F.lit(f"{first}-01-01").cast(date_type))
            & (F.col("o_orderdate") < F.lit(f"{last + 1}-01-01").cast(date_type))
        )
        .select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    )
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_extendedprice").alias("assets"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("leverage"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        )
    )
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)

    sums = []
    for y in YEARS:
        in_year = F.col("year") == int(y) - YEAR_SHIFT
        for name, source, digits in (
            ("turnover", "o_totalprice", 2),
            ("assets", "assets", 2),
            ("leverage", "leverage", 4),
            ("tax", "tax", 4),
        ):
            total = F.round(F.sum(F.when(in_year, F.col(source))), digits)
            sums.append(total.alias(f"{name}_{y}"))
    yearly = joined.groupBy("o_custkey").agg(*sums)

    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    country = F.element_at(
        F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("n_nationkey") % len(COUNTRIES) + 1).cast("int")
    )
    # nation and region hold 25 and 5 rows at every scale
    base = (
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(yearly, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    out = [
        F.col("c_custkey").alias("row_id"),
        F.col("c_custkey").alias("No"),
        F.col("c_name").alias("Company name"),
        F.col("r_name").alias("Region"),
        country.alias("Country"),
        F.col("c_nationkey").cast("string").alias("NACE code"),
        F.col("c_mktsegment").alias("Sector 1"),
        F.col("r_name").alias("Sector 2"),
    ]
    for y in YEARS:
        turnover, assets = F.col(f"turnover_{y}"), F.col(f"assets_{y}")
        leverage, tax = F.col(f"leverage_{y}"), F.col(f"tax_{y}")
        ebit = turnover - assets
        out += [
            _rating(F.try_divide(ebit, turnover)).alias(f"MScore.{y}"),
            assets.alias(f"TAsset.{y}"),
            leverage.alias(f"Leverage.{y}"),
            ebit.alias(f"EBIT.{y}"),
            turnover.alias(f"Turnover.{y}"),
            F.try_divide(ebit, assets - leverage).alias(f"ROE.{y}"),
            (ebit - tax).alias(f"PLTax.{y}"),
        ]
    return base.select(*out)


def to_long(df: DataFrame, metrics, years=YEARS, id_cols=("row_id",)) -> DataFrame:
    """Long form (id, year, metric...) of the wide panel."""
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("year"), *[col(f"{m}.{y}").alias(m) for m in metrics])
            for y in years
        ]
    )
    return df.select(*[col(c) for c in id_cols], F.inline(rows))
