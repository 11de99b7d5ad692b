"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most
``distance`` bits, some segment starts a chain along which the differing bits of the first ``k``
segments never exceed ``k * distance / SEGMENTS`` (the pigeonring principle). With four segments
and three bits: the first segment is equal, the first two differ in at most one bit, the first
three in at most two.

The first two links of the chain are the join key: an equal segment, and one equal half of the
next segment (one differing bit leaves a half untouched), 24 bits of every fingerprint at 8
positions. The later links prune a candidate before the full Hamming check.

Copies are one fingerprint. Dense groups are first linked along sorted fingerprints, which costs
a linear number of comparisons. Keys that hold one such group only are dropped, and in the others
groups meet before their members do, so a group of near copies is never expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..session import store
from .common import packed, side

BITS = 64
SEGMENTS = 4
SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42
SORT_BITS = 8


def text_fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles."""
    w = text.encode().lower().split()  # on bytes: A-Z only, the six ASCII spaces only
    if not w:
        return 0
    hashed = xxhash.xxh64_intdigest
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    block = np.fromiter((hashed(b" ".join(s), SEED) for s in shingles), dtype="<u8")
    for i in range(0, len(block), 65_536):
        part = block[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, copy, fp): one row per document; NULL counts as an empty text, whose fingerprint is 0.

    ``copy`` is a hash of the text as it is, to tell rows of the same id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = [text_fingerprint(texts[i].as_py() or "", words) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "copy", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("copy", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, schema)


def _bits(fp: Column, start: int, width: int) -> Column:
    """``width`` bits of the ring from bit ``start`` on."""
    start %= BITS
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _neighbours(fps: DataFrame, distance: int) -> DataFrame:
    """Edges between fingerprints that are neighbours in a sorted order and near, for several orders.

    Each order starts at another byte of the ring; ranges of its first bits are sorted apart.
    """
    edges = None
    for start in range(0, BITS, SORT_BITS):
        order = F.shiftrightunsigned("fp", start).bitwiseOR(F.shiftleft("fp", (BITS - start) % BITS)) if start else F.col("fp")
        ring = Window.partitionBy(F.shiftrightunsigned(order, BITS - 2 * SORT_BITS)).orderBy(order)
        near = fps.select(F.col("fp").alias("u"), F.lead("fp").over(ring).alias("v"))
        near = near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
        edges = near if edges is None else edges.unionAll(near)
    return edges


def _keys(fps: DataFrame, segments: int) -> DataFrame:
    width = BITS // segments
    half = width // 2
    keys = []
    for s in range(segments):
        first = _bits(F.col("fp"), s * width, width)
        for h in range(2):
            part = _bits(F.col("fp"), (s + 1) * width + h * half, half)
            # position, equal segment, equal half of the next
            keys.append(F.struct(F.lit(s).alias("s"), (F.lit(2 * s + h) * (1 << (width + half)) + first * (1 << half) + part).alias("key")))
    return fps.select("fp", "group", F.explode(F.array(*keys)).alias("k")).select("fp", "group", "k.s", "k.key")


def _chain(diff: Column, segments: int, distance: int) -> list[Column]:
    """For each start on the ring: do all prefixes of the chain stay within their budgets?"""
    width = BITS // segments
    counts = [F.bit_count(_bits(diff, s * width, width)) for s in range(segments)]
    out = []
    for s in range(segments):
        total, ok = F.lit(0), F.lit(True)
        for k in range(segments):
            total = total + counts[(s + k) % segments]
            ok = ok & (total <= (k + 1) * distance // segments)
        out.append(ok)
    return out


def near_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all pairs within ``distance`` bits.

    The edges have the same components as the graph of all such pairs.
    """
    if 2 * distance // segments > 1 or distance // segments:
        raise ValueError("the join key needs distance < segments and at most one bit in the first two segments")
    edges = store(_neighbours(fps, distance))
    groups = connected_components(fps.select(F.col("fp").alias("id")), edges)
    keyed = _keys(store(groups.select(F.col("id").alias("fp"), F.col("component").alias("group"))), segments)
    # a key inside one group has nothing left to link
    several = keyed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    members = store(keyed.join(several, "key", "left_semi").select("key", "group", "fp", "s"))
    # groups meet first, so that members of one group never meet each other
    named = members.select("key", "s", "group").distinct()
    meeting = named.withColumnRenamed("group", "gu").join(named.select("key", F.col("group").alias("gv")), "key").where("gu < gv")
    left = members.select("key", F.col("group").alias("gu"), F.col("fp").alias("u"))
    right = members.select("key", F.col("group").alias("gv"), F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    chains = _chain(diff, segments, distance)
    viable = F.lit(False)
    for s, ok in enumerate(chains):
        viable = viable | ((F.col("s") == s) & ok)
    met = meeting.join(left, ["key", "gu"]).join(right, ["key", "gv"])
    return edges.unionAll(met.where(viable & (F.bit_count(diff) <= distance)).select("u", "v"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE
) -> DataFrame:
    """(id, copy, fp, component_id): one row per input row.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``distance`` bits. A NULL or wordless text has fingerprint 0 and is linked like any other;
    a text of fewer than ``words`` words is one shingle. Repeated rows stay. A NULL id is kept;
    a component of NULL ids only has a NULL id. Other columns are ignored, an empty table gives
    no rows.
    """
    marked = store(fingerprints(docs, id_col, text_col, words))
    distinct = store(marked.groupBy("fp").agg(F.min("id").alias("least")))
    linked = near_links(distinct.select("fp"), distance)
    parts = store(connected_components(distinct.select(F.col("fp").alias("id")), linked))
    members = distinct.join(parts, F.col("fp") == F.col("id")).select("fp", "least", "component")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.select("fp", "component").join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    # a fingerprint that many copies share is split by adaptive execution
    return marked.join(named, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), "copy", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE
) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of rows with that id the one with the smallest text hash stays, with its repetitions. Rows
    whose group has no id all stay.
    """
    groups = store(near_groups(docs, id_col, text_col, words, distance))
    stays = groups.where(F.col(id_col) == F.col("component_id")).groupBy("component_id").agg(F.min("copy").alias("stay"))
    lost = (
        groups.join(stays, "component_id")
        .where(~(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("copy") == F.col("stay"))))
        .select(F.col(id_col).alias("lost_id"), F.col("copy").alias("lost_copy"))
    )
    lost = side(store(lost.distinct()))
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"))
    found = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("copy") == F.col("lost_copy"))
    return rows.join(lost, found, "left_anti").select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
