"""Centroid clustering by Lloyd's rounds over column blocks.

Vectors of whole numbers are cut into tiles: some thousand rows by a block of columns. In a round
a tile task computes exact partial squared distances of its rows to its block's slice of the
centroids; the partial distances of a row group meet by its key, are added, and the smallest sum
names the nearest centroid. The labels go back to the tiles, which add up their own columns per
cluster, so every block's slice of the centroids is renewed from its own tiles alone. No task
holds whole vectors, and the driver sees the centroids only (``k`` times ``dims`` numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
WIDTH = 16
TILE_ROWS = 4_096


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return a.astype(kind).tobytes()


def _unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{len(data) // max(rows * columns, 1) or 1}").astype(np.int64).reshape(rows, columns)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of the vectors with exactly ``dims`` components, all of them finite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    kept = named.where(F.col("v").isNotNull() & (F.size("v") == dims) & F.forall("v", finite))
    return kept.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * float(scale))).alias("q"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of salt and id; rows without an id never start a cluster."""
    named = vectors.where(F.col("id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    return np.array([r["q"] for r in named.orderBy("h", "q").limit(k).collect()], dtype=np.int64)


def tiles_of(vectors: DataFrame, dims: int, width: int, rows: int) -> DataFrame:
    """(tile, block, n, ids, x): ``x`` packs ``n`` rows by the columns of ``block``; ids are in block 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                q = some.column(1).flatten().to_numpy().reshape(-1, dims)
                blocks = [q[:, s : s + width] for s in range(0, dims, width)]
                tile = (part << 32) + count
                count += 1
                ids = pa.array([some.column(0).to_pylist(), *[None] * (len(blocks) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array([len(q)] * len(blocks), pa.int32()), ids, pa.array([_pack(b) for b in blocks], pa.binary())],
                    ["tile", "block", "n", "ids", "x"],
                )

    made = vectors.mapInArrow(run, "tile long, block int, n int, ids array<long>, x binary")
    return store(made.repartition("tile", "block"))


def _partial_distances(tiles: DataFrame, centroids: Broadcast, width: int) -> DataFrame:
    """(tile, n, d): squared distances of a tile's rows to all centroids within the tile's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            out = []
            for block, n, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                slice_ = c[:, block * width : (block + 1) * width]
                rows = _unpack(x, n, slice_.shape[1])
                out.append(_pack(np.column_stack([((rows - one) ** 2).sum(axis=1) for one in slice_])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["tile", "n", "d"])

    return tiles.select("tile", "block", "n", "x").mapInArrow(run, "tile long, n int, d binary")


def nearest_centroids(tiles: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(tile, n, label, distance), packed: the blocks' distances added, the smaller number on a tie."""
    k = len(centroids)

    def add(blocks: pa.Table) -> pa.Table:
        n = blocks["n"][0].as_py()
        total = sum(_unpack(d.as_py(), n, k) for d in blocks["d"])
        label = total.argmin(axis=1)
        columns = [blocks["tile"].slice(0, 1), blocks["n"].slice(0, 1), pa.array([_pack(label)], pa.binary()), pa.array([_pack(total.min(axis=1))], pa.binary())]
        return pa.table(columns, names=["tile", "n", "label", "distance"])

    shared = tiles.sparkSession.sparkContext.broadcast(centroids)
    return _partial_distances(tiles, shared, width).groupBy("tile").applyInArrow(add, "tile long, n int, label binary, distance binary")


def renewed(tiles: DataFrame, nearest: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The floor of the mean of every cluster's vectors, column block by column block; empty clusters stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, x, label in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = min(width, dims - block * width)
                if block not in sums:
                    sums[block], counts[block] = np.zeros((k, own), np.int64), np.zeros(k, np.int64)
                at = _unpack(label, n, 1)[:, 0]
                np.add.at(sums[block], at, _unpack(x, n, own))
                counts[block] += np.bincount(at, minlength=k)
        for block, total in sums.items():
            some = np.flatnonzero(counts[block])
            cluster, column = np.repeat(some, total.shape[1]), np.tile(np.arange(total.shape[1]) + block * width, len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(total[some].ravel()), pa.array(np.repeat(counts[block][some], total.shape[1]))],
                ["cluster", "dim", "s", "n"],
            )

    both = tiles.select("tile", "block", "n", "x").join(nearest.select("tile", "label"), "tile").select("block", "n", "x", "label")
    added = both.mapInArrow(run, "cluster int, dim int, s long, n long").groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in added.select("cluster", "dim", F.expr("(s - pmod(s, n)) div n").alias("v")).collect():  # k * dims rows
        out[r["cluster"], r["dim"]] = r["v"]
    return out


def centroid_clusters(
    df: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    salt: str = "1:",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    width: int = WIDTH,
    rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per kept vector.

    Kept are vectors with exactly ``dims`` finite components; all others, NULL vectors too, give no
    row. Distances are squared and must fit 64 bits. With fewer than ``k`` kept vectors with an id
    there are as many clusters as those; without any there are no rows. Repeated rows and rows with
    a NULL id are vectors like others, but a row without an id starts no cluster. Equal vectors that
    start two clusters all go to the smaller number. Other columns are ignored.
    """
    vectors = whole_vectors(df, id_col, vec_col, dims, scale)
    centroids = first_centroids(vectors, k, salt)
    tiles = tiles_of(vectors, dims, width, rows)
    schema = "id long, cluster int, distance long"
    if not len(centroids):
        found = df.sparkSession.createDataFrame([], schema)
    else:
        for _ in range(rounds):
            centroids = renewed(tiles, nearest_centroids(tiles, centroids, width), centroids, width)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, n, label, distance in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    numbers = [_unpack(x, n, 1)[:, 0] for x in (label, distance)]
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(numbers[0].astype(np.int32)), pa.array(numbers[1])], ["id", "cluster", "distance"])

        nearest = nearest_centroids(tiles, centroids, width)
        named = tiles.where("block = 0").select("tile", "ids").join(nearest, "tile").select("ids", "n", "label", "distance")
        found = store(named.mapInArrow(rows_of, schema))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    texts = [",".join(map(str, c)).encode() for c in centroids.tolist()]
    facts = [(i, int(s), hashlib.sha256(texts[i]).hexdigest()) for i, s in sums.items()]
    table = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256"
    )
