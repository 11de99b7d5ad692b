"""Isolation forest: a table of nodes grown on small hash samples, rows scored with the whole table.

All draws are digits of md5 hashes of row, tree and node, so a forest does not depend on
partitioning and can be grown again in any language that has md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col, complete_rows
from ..session import store

TREES = 100
TREE_ROWS = 256
#: The children of node ``i`` are ``2 i`` (values up to the cut) and ``2 i + 1``; a leaf has no feature.
NODE_SCHEMA = "tree int, node long, feature int, cut double, depth double"
EULER = 0.5772156649015329
PLACES = 1 << 40


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, key: str, cols: Sequence[str], n: int, trees: int, rows: int, seed: int) -> DataFrame:
    """(tree, x0..): ``rows`` rows per tree in hash order, so re-partitioning changes nothing.

    Two numbers from the md5 of a row's key give its place in every tree, ``(a + tree * b) mod
    2^40``. Places below a limit are about four times the wanted rows; of those the lowest stay.
    One rule at every size: rows are only multiplied by the trees that may keep them.
    """
    values = [col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    slim = complete_rows(df.select(col(key).cast("string").alias("_key"), *values))
    limit = int(PLACES * min(1.0, 4.0 * rows / max(n, 1)))
    digest = F.md5(F.concat(F.col("_key"), F.lit(f"|{seed}")))
    part = lambda start: F.conv(F.substring(digest, start, 11), 16, 10).cast("long")
    slim = slim.withColumns({"_a": part(1), "_b": part(12)})
    place = lambda t: F.pmod(F.col("_a") + t * F.col("_b"), F.lit(PLACES))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < F.lit(limit))
    dealt = slim.withColumn("tree", F.explode(chosen)).withColumn("_place", place(F.col("tree"))).drop("_a", "_b")
    order = Window.partitionBy("tree").orderBy("_place", "_key")
    return dealt.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= rows).drop("_place")


def _draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a node."""
    digits = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(digits[:12], 16) / 2.0**48, int(digits[12:24], 16) / 2.0**48


def _grow(dims: int, seed: int, limit: int):
    xs = [f"x{i}" for i in range(dims)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_rn")[xs].to_numpy(dtype=float)
        nodes, todo = [], [(1, np.arange(len(data)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            part = data[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or not len(usable):
                nodes.append((tree, node, None, None, depth + _path_length(len(rows))))
                continue
            which, where = _draws(seed, tree, node)
            f = int(usable[int(which * len(usable))])
            cut = float(low[f] + where * (high[f] - low[f]))
            cut = float(low[f]) if cut >= high[f] else cut  # both sides keep a row
            goes_below = part[:, f] <= cut
            nodes.append((tree, node, f, cut, None))
            todo += [(2 * node, rows[goes_below], depth + 1), (2 * node + 1, rows[~goes_below], depth + 1)]
        return pd.DataFrame(nodes, columns=[c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]).astype({"feature": "Int32"})

    return run


def grow_forest(
    df: DataFrame, key: str, cols: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42
) -> tuple[DataFrame, int]:
    """(nodes, rows a tree has): the node table, at most ``trees * (2 * rows - 1)`` rows."""
    n = complete_rows(df.select(*[col(c) for c in cols])).count()
    size = min(rows, n)
    limit = int(np.ceil(np.log2(max(size, 2))))
    samples = tree_samples(df, key, cols, n, trees, size, seed)
    return store(samples.groupBy("tree").applyInPandas(_grow(len(cols), seed, limit), NODE_SCHEMA)), size


def score_rows(df: DataFrame, cols: Sequence[str], nodes: DataFrame, size: int, out: str = "_score") -> DataFrame:
    """``df`` with the anomaly score that a node table gives, NULL for incomplete rows.

    The table is bounded by the forest's parameters, so every task gets it as arrays; rows walk all
    trees in Arrow batches, a level at a time.
    """
    grown = nodes.toPandas()
    forest = []
    for _, t in grown.groupby("tree"):
        t = t.sort_values("node")
        number, feature = t["node"].to_numpy(), t["feature"].fillna(-1).to_numpy(dtype=np.int64)
        below, above = np.searchsorted(number, 2 * number), np.searchsorted(number, 2 * number + 1)
        forest.append((feature, t["cut"].to_numpy(), below, above, t["depth"].to_numpy()))
    norm = max(_path_length(size), 1e-12)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, below, above, depth in forest:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    value = x[every, np.maximum(f, 0)]
                    at = np.where(inner, np.where(value <= cut[at], below[at], above[at]), at)
                total += depth[at]
            result = 2.0 ** (-total / (max(len(forest), 1) * norm))
            result[np.isnan(x).any(axis=1)] = np.nan
            yield pd.Series(result)

    scorer = F.pandas_udf(score, "double")
    scored = df.withColumn(out, scorer(*[col(c).cast("double") for c in cols]))
    return scored.withColumn(out, F.nanvl(F.col(out), F.lit(None)))


def anomaly_scores(
    df: DataFrame, key: str, cols: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42, out: str = "_score"
) -> DataFrame:
    """``df`` with an anomaly score in (0, 1], NULL for incomplete rows."""
    nodes, size = grow_forest(df, key, cols, trees, rows, seed)
    return score_rows(df, cols, nodes, size, out)
