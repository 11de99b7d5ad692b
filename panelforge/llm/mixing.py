"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a target share of the words; whole epochs of a source come first, and what is
left of its target is filled with documents in the order of exponential keys ``-ln(u) / weight``
(Efraimidis and Spirakis), where ``u`` is a hash of the document id and ``weight`` its quality.
Keys are sorted and prefix-summed in buckets of about ``bucket_rows`` documents of a source, so
no source is sorted in one task, and bucket totals give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import store
from .common import numbered, packed, row_order, side, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_ROWS = 1_000
SEED = "mix"


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """(sid, source, source_size, docs, target) from (source, size).

    Sources in code point order, NULL last, weigh ``weights`` over and over and share
    ``share`` times all words. A target stops at ``most_epochs`` times its source's words; the
    excess is shared again by weight until no target is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = numbered(per, [F.col("source").asc_nulls_last()], "sid")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    ranked = store(ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most_epochs)))
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = share * words
    level, full = 0.0, -1
    while True:  # each round fills more sources or ends
        over = F.lit(level) * F.col("w") >= F.col("cap")
        row = ranked.agg(
            F.count_if(over).alias("full"),
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"),
        ).first()
        if row["full"] == full or not row["w"]:
            break
        full, level = row["full"], max(budget - row["caps"], 0.0) / row["w"]
    target = F.col("cap") if row["w"] == 0 else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return ranked.select("sid", "source", "source_size", "docs", target.alias("target"))


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the id, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies): one row per document.

    ``quality`` has (id, weight), one row per id: the quality weight of a document (positive;
    absent, NULL, zero and less count as 1).
    ``taken`` counts words, repeats included: whole epochs, plus the document once more when
    the middle of its words falls within what is left of the target; ``copies`` is how often
    the document itself is taken. A NULL text has size 0
    and takes nothing; a NULL source is a source of its own, the last one. Equal keys go by id,
    then by size; repeated rows are documents of their own. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if quality is None:
        sized = sized.withColumn("quality", F.lit(1.0))
    else:
        known = quality.select(F.col("id").alias("_id"), F.col("weight").cast("double").alias("_weight"))
        positive = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(1.0)
        sized = sized.join(known, F.col("id") == F.col("_id"), "left").select("id", "source", "size", positive.alias("quality"))
    sized = store(sized)
    sources = store(source_targets(sized, weights, share, most_epochs))
    per = side(sources.withColumnRenamed("source", "_source"), F.coalesce(F.octet_length("_source"), F.lit(0)))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    key = -F.log(uniform(F.col("id"))) / F.col("quality")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows))
    dealt = (
        sized.join(per, F.col("source").eqNullSafe(F.col("_source")))
        .select("id", "size", "sid", "source_size", "target", epochs.alias("epochs"), key.alias("key"), buckets.alias("buckets"))
        # keys are exponential, so this maps them to about even buckets in key order
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "size")
    running = dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = side(store(totals.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("offset") + F.col("upto") - F.col("size") / 2
    copies = (F.col("epochs") + (middle <= left).cast("int")).cast("long")
    return running.join(offsets, ["sid", "bucket"]).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows that the mix takes, with all their columns, each as often as it is taken.

    Rows that share an id also share what is taken of them, as evenly as it goes.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    taken = mix_sources(docs, id_col, text_col, source_col, **options).groupBy(name.alias("key")).agg(
        F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows")
    )
    taken = store(taken.where("total > 0"))
    rows = docs.select(packed(docs).alias("row"), name.alias("key"))
    every = rows.join(taken.where("rows = 1"), "key").select("row", F.col("total").alias("copies"))
    shared = taken.where("rows > 1")
    if not shared.isEmpty():
        every = every.unionAll(_shared(docs, name, shared))
    every = every.withColumn("copies", F.col("copies").cast("int")).where("copies > 0")
    return every.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def _shared(docs: DataFrame, name: Column, taken: DataFrame) -> DataFrame:
    """(row, copies) for rows that share an id; places are global positions, so no id is one task's."""
    rows = docs.select(packed(docs).alias("row"), row_order(docs).alias("order"), name.alias("key"))
    # ``uid`` only splits equal rows, which may change places
    joined = store(rows.join(side(taken, F.octet_length("key")), "key").withColumn("uid", F.monotonically_increasing_id()))
    placed = store(numbered(joined, [F.col("key"), F.col("order"), F.col("uid")], "place"))
    first = store(placed.groupBy("key").agg(F.min("place").alias("first")))
    place = F.col("place") - F.col("first")
    share = F.floor(F.col("total") / F.col("rows")) + (place < F.col("total") % F.col("rows")).cast("long")
    return placed.join(side(first, F.octet_length("key")), "key").select("row", share.alias("copies"))
