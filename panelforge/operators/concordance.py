"""Exact sums over all row pairs for every column pair, in n log n work.

For columns x, y two sums are needed over row pairs: sgn(dx) sgn(dy) (Kendall) and
|dx| |dy| (distance covariance). Both are signed sums over products, so a pair of
*groups* whose order is known on both axes contributes through group totals
(count, sum x, sum y, sum xy) alone. Rows are bucketed by value on every axis:

* same x bucket: compared inside the bucket,
* same y bucket but different x buckets: compared inside the y bucket,
* different buckets on both axes: compared as cells (x bucket, y bucket).

No row pair is ever materialised, and no task holds more than one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import ROWS_PER_BUCKET, value_buckets

PAIR_SCHEMA = "i int, j int, k double, d double"
GRID_SIDE = 1024
#: Columns that a task compares its own column with: a task's memory follows from them and the bucket's rows.
TASK_COLUMNS = 16


def signed_pair_sums(xkey: np.ndarray, ykey: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Sums of sgn sgn and sgn sgn dx dy over all pairs of weighted points.

    ``xkey`` and ``ykey`` order the points; ``w`` has columns count, sum x, sum y, sum xy. Points
    whose x keys differ are told apart by exactly one highest differing bit, so each bit
    is one vectorised sweep over the points in y order.
    """
    if len(xkey) < 2:
        return 0.0, 0.0
    n = len(xkey)
    _, x, counts = np.unique(xkey, return_inverse=True, return_counts=True)
    bits = (len(counts) - 1).bit_length()
    if bits == 0:
        return 0.0, 0.0
    order = np.argsort(ykey, kind="stable")
    x, y = x[order].astype(np.int32), np.asarray(ykey)[order]
    w = [np.ascontiguousarray(w[order, f], dtype=float) for f in range(4)]
    # points with the same leading bits of x stand side by side, in y order
    first = np.r_[0, np.cumsum(counts)[:-1]]
    other = y[1:] != y[:-1]
    tied = not other.all()
    y = np.r_[0, np.cumsum(other)].astype(np.int32)
    k_total = d_total = 0.0
    for bit in range(bits - 1, -1, -1):
        starts = first[:: 1 << (bit + 1)]
        bounds = np.r_[starts, n]
        right = (x >> bit & 1).astype(bool)
        high = [np.where(right, f, 0.0) for f in w]
        low = [np.concatenate([[0.0], np.cumsum(np.where(right, 0.0, f))]) for f in w]
        if tied:
            new = np.r_[True, y[1:] != y[:-1]]
            new[starts] = True
            runs = np.flatnonzero(new)
            ends = np.r_[runs[1:], n]
            k, d = _products([np.add.reduceat(f, runs) for f in high], [f[runs] + f[ends] for f in low])
        else:
            k, d = _products(high, [2.0 * f[:-1] for f in low])
        # lower less higher points of the block: twice those up to here less all before and all through the block
        k_block, d_block = _products([np.add.reduceat(f, starts) for f in high], [f[starts] + f[bounds[1:]] for f in low])
        k_total += k - k_block
        d_total += d - d_block
        if bit:
            # next bit: same y order inside each half block
            rights = np.add.reduceat(right, starts, dtype=np.int64)
            lefts = np.diff(bounds) - rights
            is_left, is_right = np.flatnonzero(~right), np.flatnonzero(right)
            moved = np.empty(n, dtype=np.int64)
            moved[np.arange(len(is_left)) + np.repeat(np.cumsum(rights) - rights, lefts)] = is_left
            moved[np.arange(len(is_right)) + np.repeat(np.cumsum(lefts), rights)] = is_right
            x, y, w = x[moved], y[moved] if tied else y, [f[moved] for f in w]
    return k_total, d_total


def _products(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float]:
    """Sums of the products of two groups' counts, and of their products of differences."""
    return float(a[0] @ b[0]), float(a[3] @ b[0] - a[1] @ b[2] - a[2] @ b[1] + a[0] @ b[3])


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, y, x * y])


def _bucket_task(p: int, centre: Sequence[float], with_cells: bool):
    """One bucket of column ``c`` (x) against a few other columns (y0.. with their buckets d0..)."""
    centre = np.asarray(centre, dtype=float)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, b, part = (int(k) for k in key)
        x = pdf["x"].to_numpy(dtype=float)
        out = []
        if part == c // TASK_COLUMNS:
            counts = np.unique(x, return_counts=True)[1].astype(float)
            out.append(("tie", c, c, 0, 0, float((counts * (counts - 1) / 2).sum()), 0.0, 0.0, 0.0))
        for at in range(min(TASK_COLUMNS, p - part * TASK_COLUMNS)):
            j = part * TASK_COLUMNS + at
            if j == c or j < c and not with_cells:
                continue
            y, bj = pdf[f"y{at}"].to_numpy(dtype=float), pdf[f"d{at}"].to_numpy(dtype=np.int64)
            vx, vy = x - centre[c], y - centre[j]
            if j < c:
                k, d = signed_pair_sums(bj, x, _weights(vy, vx))
                out.append(("sum", j, c, 0, 0, k, d, 0.0, 0.0))
                continue
            k, d = signed_pair_sums(x, y, _weights(vx, vy))
            out.append(("sum", c, j, 0, 0, k, d, 0.0, 0.0))
            if with_cells:
                n, sx = np.bincount(bj), np.bincount(bj, weights=vx)
                sy, sxy = np.bincount(bj, weights=vy), np.bincount(bj, weights=vx * vy)
                out += [
                    ("cell", c, j, b, int(t), float(n[t]), float(sx[t]), float(sy[t]), float(sxy[t]))
                    for t in np.flatnonzero(n)
                ]
        return pd.DataFrame(out, columns=["kind", "i", "j", "bi", "bj", "n", "sx", "sy", "sxy"])

    return run


def _task_columns(anchored: DataFrame, p: int, with_cells: bool) -> DataFrame:
    """(c, b, part, x, y.., d..): every row of a bucket with a few columns at a time."""
    last = (p - 1) // TASK_COLUMNS
    first = F.lit(0) if with_cells else F.floor(F.col("c") / TASK_COLUMNS).cast("int")
    values, numbers = F.array(*[F.col(f"v{i}") for i in range(p)]), F.array(*[F.col(f"b{i}") for i in range(p)])
    held = anchored.select("c", "b", values.alias("v"), numbers.alias("d"), F.explode(F.sequence(first, F.lit(last))).alias("part"))
    places = [(F.col("part") * TASK_COLUMNS + i).cast("int") for i in range(min(TASK_COLUMNS, p))]
    return held.select(
        "c",
        "b",
        "part",
        F.get("v", F.col("c")).alias("x"),
        *[F.coalesce(F.get("v", at), F.lit(0.0)).alias(f"y{i}") for i, at in enumerate(places)],
        *[F.coalesce(F.get("d", at), F.lit(0)).alias(f"d{i}") for i, at in enumerate(places)],
    )


CELL_SCHEMA = "kind string, i int, j int, bi int, bj int, n double, sx double, sy double, sxy double"


def _cell_task(pdf: pd.DataFrame) -> pd.DataFrame:
    w = pdf[["n", "sx", "sy", "sxy"]].to_numpy(dtype=float)
    k, d = signed_pair_sums(pdf["xk"].to_numpy(), pdf["yk"].to_numpy(), w)
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "j": [pdf["j"].iloc[0]], "k": [k], "d": [d]})


def _cell_sums(cells: DataFrame, side: int, grid_side: int = GRID_SIDE) -> list[DataFrame]:
    """Signed sums over cell pairs differing on both axes; coarsens until one grid fits a task."""
    parts = []

    def compared(frame: DataFrame, xk, yk, *group) -> DataFrame:
        keyed = frame.select("i", "j", "n", "sx", "sy", "sxy", xk.alias("xk"), yk.alias("yk"), *group)
        names = ["i", "j", *["g"] * bool(group)]
        return keyed.groupBy(*names).applyInPandas(_cell_task, PAIR_SCHEMA)

    while side > grid_side:
        step = math.ceil(side / grid_side)
        wide_x, wide_y = F.floor(F.col("bi") / step).cast("int"), F.floor(F.col("bj") / step).cast("int")
        parts.append(compared(cells, F.col("bi"), F.col("bj"), wide_x.alias("g")))
        parts.append(compared(cells, wide_x, F.col("bj"), wide_y.alias("g")))
        cells = cells.groupBy("i", "j", wide_x.alias("bi"), wide_y.alias("bj")).agg(
            *[F.sum(m).alias(m) for m in ("n", "sx", "sy", "sxy")]
        )
        side = math.ceil(side / step)
    parts.append(compared(cells, F.col("bi"), F.col("bj")))
    return parts


def pair_sums(
    df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, grid_side: int = GRID_SIDE
) -> tuple[DataFrame, DataFrame, int]:
    """(sums, ties, n): sums (i, j, k, d) for i < j, ties (c, t) = tied row pairs per column.

    Only rows complete in ``cols`` take part.
    """
    from ..session import cut_lineage

    p = len(cols)
    buckets = value_buckets(df, cols, (), rows_per_bucket)
    frame, n = buckets.frame, buckets.n
    means = frame.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(p)]).first()
    centre = [means[f"m{i}"] or 0.0 for i in range(p)]
    with_cells = buckets.count > 1

    anchors = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"b{i}").alias("b")) for i in range(p)])
    exploded = frame.select("*", F.inline(anchors))
    single = buckets.is_single(F.col("b"))
    grouped = _task_columns(exploded.where(~single), p, with_cells).groupBy("c", "b", "part")
    results = grouped.applyInPandas(_bucket_task(p, centre, with_cells), CELL_SCHEMA)
    if not with_cells:
        results = cut_lineage(results)
        sums = results.where("kind = 'sum'").select("i", "j", F.col("n").alias("k"), F.col("sx").alias("d"))
        ties = results.where("kind = 'tie'").select(F.col("i").alias("c"), F.col("n").alias("t"))
        return sums, ties, n

    # one-value buckets only tie inside; they still are cells, totalled without a gather
    if buckets.any_single:
        alone = exploded.where(single)
        size = alone.groupBy("c", "b").agg(F.count(F.lit(1)).cast("double").alias("m"))
        others = F.array(
            *[
                F.struct(
                    F.lit(j).alias("j"), F.col(f"b{j}").alias("bj"), (F.col(f"v{j}") - F.lit(centre[j])).alias("y")
                )
                for j in range(p)
            ]
        )
        own = F.array(*[F.col(f"v{i}") - F.lit(centre[i]) for i in range(p)])[F.col("c")]
        pairs = alone.select("c", "b", own.alias("x"), F.inline(others)).where("j > c")
        lone_cells = pairs.groupBy(F.col("c").alias("i"), "j", F.col("b").alias("bi"), "bj").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum("x").alias("sx"),
            F.sum("y").alias("sy"),
            F.sum(F.col("x") * F.col("y")).alias("sxy"),
        )
        zero = F.lit(0.0)
        lone_ties = size.select(
            F.lit("tie").alias("kind"),
            F.col("c").alias("i"),
            F.col("c").alias("j"),
            F.lit(0).alias("bi"),
            F.lit(0).alias("bj"),
            (F.col("m") * (F.col("m") - 1) / 2).alias("n"),
            zero.alias("sx"),
            zero.alias("sy"),
            zero.alias("sxy"),
        )
        lone = lone_cells.select(F.lit("cell").alias("kind"), "i", "j", "bi", "bj", "n", "sx", "sy", "sxy")
        results = results.unionAll(lone).unionAll(lone_ties)
    results = cut_lineage(results)  # read by every branch below
    local = results.where("kind = 'sum'").select("i", "j", F.col("n").alias("k"), F.col("sx").alias("d"))
    cells = results.where("kind = 'cell'").drop("kind")
    merged = local
    for part in _cell_sums(cells, buckets.count, grid_side):
        merged = merged.unionAll(part)
    sums = merged.groupBy("i", "j").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    ties = results.where("kind = 'tie'").groupBy(F.col("i").alias("c")).agg(F.sum("n").alias("t"))
    return sums, ties, n
