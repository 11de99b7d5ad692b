"""Helpers for the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..operators.clean import clean_panel
from ..operators.features import build_features
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.panel import company_panel
from ..sources.tables import StageStore
from ..sources.tables import read_table as table

__all__ = ["table", "r", "rounded", "cleaned_panel", "feature_frame", "long_sql", "points", "scratch_store", "XS"]

EMBED_DIMS = 64
XS = [f"x{i + 1}" for i in range(EMBED_DIMS)]


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    names = set(cols)
    return df.select(*[r(col(c), digits).alias(c) if c in names else col(c) for c in df.columns])


def cleaned_panel(spark: SparkSession, d: str) -> DataFrame:
    return clean_panel(company_panel(spark, d))[0]


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    """Features of the cleaned panel, stored as the plans store them."""
    return cut_lineage(build_features(cleaned_panel(spark, d)))


def scratch_store(spark: SparkSession, name: str) -> StageStore:
    """Stages of one call, in the folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    return StageStore(spark, f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}", name)


def points(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, x1..x64): every coordinate of every embedding."""
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(XS)]
    )


def points_sql() -> str:
    xs = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {x}" for i, x in enumerate(XS))
    return f"pts AS (SELECT vec_id, label, {xs} FROM embeddings)"


def long_sql(source: str, cols: Sequence[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST("{c}" AS DOUBLE) AS value FROM {source}""" for c in cols
    )
