"""Exact dedup by content sort.

Texts are compared after deleting the six ASCII space characters. Sampled splitters deal the
rows into ranges of their normalised bytes, an external sort inside each range places equal
texts side by side, and neighbours are compared in full.

The range key is the first ``PREFIX`` normalised characters, then a hash of the whole text:
splitters stay small however long the texts are, and texts that share a header are still
dealt evenly. Equal texts have equal keys, so they stay adjacent. A text with more than
``hot_rows`` copies gets one range key per ``hot_rows`` copies; the heads of its ranges meet
in a second, small comparison of the full texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import store
from .common import packed, row_order, side, squeezed

PREFIX = 64
HOT_ROWS = 1_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per input row.

    Of equal texts the row with the most code points in its original text stays, then the
    smallest id. NULL text counts as empty, so all empty and blank-only texts are one group.
    A NULL id sorts after all others. Of repeated rows (same id and text) exactly one is
    ``kept``. Other columns are ignored; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(raw).cast("long").alias("points"), squeezed(raw).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = store(counts.select(F.col("h").alias("hot_h"), F.ceil(F.col("n") / hot_rows).cast("long").alias("ways")))
    salted = (
        rows.join(side(hot), F.col("h") == F.col("hot_h"), "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "points"), F.col("ways")), F.lit(-1)))
        .drop("hot_h", "ways")
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
    )
    dealt = salted.repartitionByRange("prefix", "h", "salt")
    run = Window.partitionBy("prefix", "h", "salt", "norm")
    best = [F.col("points").desc(), F.col("id").asc_nulls_last()]
    first = run.orderBy(*best)
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "id", "salt", "norm",
        F.row_number().over(first).alias("place"),
        F.first("id").over(whole).alias("keep_id"),
        F.first("points").over(whole).alias("keep_points"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
    )
    # the text goes on only for the heads of the ranges of a hot text
    split_head = (F.col("place") == 1) & (F.col("salt") >= 0)
    runs = store(
        runs.select(
            "id", "salt", "place", "keep_id", "keep_points", "group_size",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(split_head, F.col("norm")).alias("head"),
        )
    )
    heads = runs.where(split_head).select("salt", "keep_id", "keep_points", "group_size", "text_sha256", "head")
    by_best = Window.partitionBy("text_sha256", "head").orderBy(F.col("keep_points").desc(), F.col("keep_id").asc_nulls_last())
    merged = heads.select(
        F.col("text_sha256").alias("sha"),
        F.row_number().over(by_best).alias("_r"),
        F.col("salt").alias("top_salt"),
        F.col("keep_id").alias("top_id"),
        F.sum("group_size").over(Window.partitionBy("text_sha256", "head")).alias("top_size"),
    )
    merged = store(merged.where("_r = 1").drop("_r"))
    joined = runs.drop("head").join(side(merged, F.lit(80)), (F.col("salt") >= 0) & (F.col("text_sha256") == F.col("sha")), "left")
    split = F.col("sha").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(split, F.col("top_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(split, F.col("top_size")).otherwise(F.col("group_size")).alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("salt") == F.col("top_salt")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, which may be of any type.

    Of rows that share an id and a text the first in the order of all their columns stays.
    """
    # rows that share an id and a text are interchangeable, so (id, text hash) finds what stays
    key = lambda i, sha: F.concat_ws("|", F.col(i).cast("string"), sha)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(key(id_col, F.col("text_sha256")).alias("key"))
    points = F.length(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(packed(docs).alias("row"), row_order(docs).alias("order"), key(id_col, F.sha2(squeezed(F.col(text_col)), 256)).alias("key"), points.alias("points"))
    one = Window.partitionBy("key").orderBy(F.col("points").desc(), "order")
    return rows.join(kept, "key", "left_semi").withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")
