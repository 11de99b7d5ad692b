"""Grouped comparison of queries with candidates, in tasks of bounded size.

``queries`` and ``candidates`` share a group column ``g``. A large group is cut into
query chunks and candidate chunks and every chunk pair becomes one task; small groups
are packed together, so a task never holds more than about ``2 * rows`` rows whatever
the skew, or ``LARGER`` times that where there are many copies; comparisons of still more copies go in passes. Pairs live only as NumPy blocks inside a task; tasks emit what
their function returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, store

CHUNK_ROWS = 20_000
#: Rows, copies for the tasks included, that a comparison shuffles at once. Above, chunks are so many times larger, and there are several passes.
MOVED_ROWS, LARGER = 12_000_000, 3
SMALL_GROUP = 512
BLOCK_CELLS = 500_000
#: Shape of the matrices that are filled by one product: they stay in the cache of a core.
TILE_ROWS, TILE_COLUMNS = 256, 2_048
#: Points of a box, and queries that look for boxes together; the most directions a box has, and the least share of the widest.
BOX_ROWS, STRIP_ROWS = 64, 64
BOX_COLUMNS, BOX_SHARE = 12, 1e-4
#: Pairs whose differences are taken at once.
EXACT_PAIRS = 20_000
BROADCAST_GROUPS = 200_000

Rows = dict[str, np.ndarray]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by differences, exact 0 for equal points."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        diff = a[:, f, None] - b[None, :, f]
        out += diff * diff
    return out


def block_step(n_cols: int) -> int:
    """Rows per block so a distance matrix with ``n_cols`` columns fits in memory."""
    return max(1, BLOCK_CELLS // max(n_cols, 1))


def pair_squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What ``square_distances`` holds at the places (i, j)."""
    out = np.zeros(len(i))
    for s in range(0, len(i), EXACT_PAIRS):
        part = slice(s, s + EXACT_PAIRS)
        diff = a[i[part]] - b[j[part]]
        diff *= diff
        for f in range(diff.shape[1]):  # in the order of the columns, as the sum over a matrix
            out[part] += diff[:, f]
    return out


class Products:
    """Squared distances by matrix products, with a bound on what rounding may have moved them.

    A product with rows (x, |x|^2, 1) and columns (-2 y, 1, |y|^2) costs a small part of taking
    differences. Points are moved to the candidates' mean first, so the bound follows their spread.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        with np.errstate(all="ignore"):
            centre = b.mean(axis=0) if len(b) else np.zeros(a.shape[1])
            p, q = a - centre, b - centre
            self.na, self.nb = (p * p).sum(axis=1), (q * q).sum(axis=1)
            # infinite or overflowing values are left to differences
            self.safe = bool((self.na < 1e300).all() and (self.nb < 1e300).all())
            self.left = np.column_stack([p, self.na, np.ones(len(p))])
            self.right = np.ascontiguousarray(np.column_stack([-2.0 * q, np.ones(len(q)), self.nb]).T)
        self.unit = 4 * np.finfo(float).eps * (a.shape[1] + 8)

    def tile(self, rows: slice | np.ndarray, columns: slice | np.ndarray) -> tuple[np.ndarray, float]:
        """(squares, slack): no square is off by more than ``slack``."""
        if not self.safe:
            with np.errstate(all="ignore"):
                return square_distances(self.a[rows], self.b[columns]), 0.0
        na, nb = self.na[rows], self.nb[columns]
        slack = self.unit * (na.max() + nb.max()) if len(na) and len(nb) else 0.0
        return self.left[rows] @ self.right[:, columns], float(slack)

    def distances(self, rows: slice | np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
        """Distances; where points nearly coincide, and products lose digits, by differences."""
        square, slack = self.tile(rows, columns)
        if slack:
            close = np.flatnonzero(square.ravel() <= 1e8 * slack)
            if len(close):
                i, j = np.divmod(close, square.shape[1])
                square.ravel()[close] = pair_squares(self.a, self.b, _places(rows, len(self.a))[i], _places(columns, len(self.b))[j])
        return np.sqrt(square, out=square)


def _places(part: slice | np.ndarray, n: int) -> np.ndarray:
    return np.arange(n)[part] if isinstance(part, slice) else part


def near_order(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): runs of at most ``most`` points that lie near each other, by halves at the median of the widest coordinate."""
    order, starts, open_ = np.arange(len(x)), [], [(0, len(x))]
    while open_:
        s, e = open_.pop()
        if e - s <= most:
            starts.append(s)
            continue
        part = order[s:e]
        held = x[part]
        low, high = held.min(axis=0), held.max(axis=0)
        along = held[:, int((high - low).argmax())]
        order[s:e] = part[np.argsort(along, kind="stable")] if e - s <= 2 * most else part[np.argpartition(along, (e - s) // 2)]
        middle = s + (e - s) // 2
        open_ += [(middle, e), (s, middle)]
    return order, np.array(starts, dtype=np.int64)


class _Boxes:
    """Runs of points as boxes along the main directions of the candidates, which bound distances from below.

    Turned coordinates keep distances, and a few of them never exceed the whole; rounding is left to a slack that follows the largest norm.
    """

    def __init__(self, c: np.ndarray):
        self.centre = c.mean(axis=0)
        moved = c - self.centre
        spread, turn = np.linalg.eigh(moved.T @ moved)
        self.turn = turn[:, ::-1][:, :BOX_COLUMNS]
        # directions that add nothing to the spread bound nothing
        self.turn = self.turn[:, : max(1, int((spread[::-1][:BOX_COLUMNS] > BOX_SHARE * spread[-1]).sum()))]
        self.y = moved @ self.turn
        self.order, self.start = near_order(self.y, BOX_ROWS)
        self.low = np.minimum.reduceat(self.y[self.order], self.start)
        self.high = np.maximum.reduceat(self.y[self.order], self.start)
        self.end = np.r_[self.start[1:], len(c)]
        self.largest = float(np.sqrt((moved * moved).sum(axis=1).max()))

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        moved = q - self.centre
        return moved @ self.turn, 1e-9 * (self.largest + float(np.sqrt((moved * moved).sum(axis=1).max())))

    def near(self, y: np.ndarray, radius: np.ndarray, slack: float) -> np.ndarray:
        """The candidates of all boxes that some query reaches, those of the nearest boxes first."""
        reach = np.square(radius * (1 + 1e-9) + slack)
        # the box of the queries rules out most boxes at once
        away = np.maximum(np.maximum(self.low - y.max(axis=0), y.min(axis=0) - self.high), 0.0)
        apart = np.square(away).sum(axis=1)
        some = np.flatnonzero(apart <= reach.max())
        some = some[np.argsort(apart[some], kind="stable")]
        low, high = self.low[some], self.high[some]
        apart = np.zeros((len(y), len(some)))
        for f in range(y.shape[1]):
            away = np.maximum(low[:, f] - y[:, f, None], y[:, f, None] - high[:, f])
            apart += np.square(np.maximum(away, 0.0, out=away), out=away)
        some = some[(apart <= reach[:, None]).any(axis=0)]
        return np.concatenate([self.order[s:e] for s, e in zip(self.start[some], self.end[some])]) if len(some) else self.order[:0]


def strips(q: Rows, c: Rows, products: Products, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, candidates): few queries that lie near each other and the candidates of all boxes near one of them.

    A box is left out when all its points are further than ``radius`` from each query, whatever cells they come from.
    """
    every = np.arange(len(c["x"]))
    if not products.safe or not len(every) or not len(q["x"]):
        for s in range(0, len(q["x"]), TILE_ROWS):
            yield np.arange(s, min(s + TILE_ROWS, len(q["x"]))), every
        return
    boxes = _Boxes(c["x"])
    y, slack = boxes.turned(q["x"])
    for wide in _runs(y, np.arange(len(y)), TILE_ROWS):
        met = boxes.near(y[wide], radius[wide], slack)
        if 2 * len(met) > len(every):
            # many candidates are met in one product; fewer queries would hardly meet less
            yield wide, every if len(met) == len(every) else met
            continue
        for rows in _runs(y, wide, STRIP_ROWS):
            yield rows, boxes.near(y[rows], radius[rows], slack)


def _runs(y: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    order, start = near_order(y[rows], most)
    return np.split(rows[order], start[1:])


def tiles(rows: np.ndarray, columns: np.ndarray, products: Products) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(candidates, squares, slack) for the strip, some candidates at a time."""
    for s in range(0, len(columns), TILE_COLUMNS):
        part = columns[s : s + TILE_COLUMNS]
        # columns side by side need no copy
        aside = part[-1] - part[0] == len(part) - 1 and bool((np.diff(part) == 1).all())
        yield part, *products.tile(rows, slice(part[0], part[-1] + 1) if aside else part)


def least_places(rows: np.ndarray, columns: np.ndarray, products: Products, keep: int, limit: np.ndarray, weigh=None) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``rows``, candidate) of pairs with the ``keep`` + 1 least squares of every row, as far as they are within ``limit``.

    Some more pairs are given where products cannot tell; the caller decides by differences. ``weigh`` turns squares of a tile into
    heights in place, and a slack of squares into one per row.
    """
    slack = products.unit * float(products.na[rows].max() + products.nb.max()) if products.safe and len(rows) and len(columns) else 0.0
    reach = weigh(None, None, slack) if weigh else np.full(len(rows), slack)
    bound, top, found = limit + reach, np.full((len(rows), keep + 1), np.inf), []
    for part, value, _ in tiles(rows, columns, products):
        if weigh:
            weigh(value, part, slack)
        hit = value <= bound[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * (keep + 1))
        if len(many):
            # so many candidates are no further: none beyond the last of them is among the least
            bound[many] = np.minimum(bound[many], np.partition(value[many], keep, axis=1)[:, keep] + 2 * reach[many])
            hit[many] = value[many] <= bound[many, None]
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        i, j = np.divmod(at, len(part))
        v = value.ravel()[at]
        start = np.searchsorted(i, np.arange(len(rows) + 1))
        held = np.full((len(rows), keep + 1 + int(np.diff(start).max())), np.inf)
        held[:, : keep + 1] = top
        held[i, keep + 1 + np.arange(len(i)) - start[i]] = v
        top = np.partition(held, keep, axis=1)[:, : keep + 1]
        bound = np.minimum(bound, top[:, keep] + 2 * reach)
        found.append((i, part[j], v))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j, v = (np.concatenate(f) for f in zip(*found))
    left = v <= bound[i]
    return i[left], j[left]


def _sorted_arrays(pdf: pd.DataFrame) -> Rows:
    """Columns as arrays in (g, id) order; coordinates x0, x1, ... as one matrix ``x``."""
    order = np.lexsort((pdf["id"].to_numpy(), pdf["g"].to_numpy()))
    xs = sorted((c for c in pdf.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    rows = {c: pdf[c].to_numpy()[order] for c in pdf.columns if c not in xs}
    rows["x"] = pdf[xs].to_numpy(dtype=float)[order]
    return rows


def _packed(task: Callable[[Rows, Rows], Rows | None], columns: list[str]):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        parts: list[Rows] = []
        if len(queries) and len(candidates):
            q, c = _sorted_arrays(queries), _sorted_arrays(candidates)
            groups, starts = np.unique(q["g"], return_index=True)
            ends = np.r_[starts[1:], len(q["g"])]
            left, right = np.searchsorted(c["g"], groups, "left"), np.searchsorted(c["g"], groups, "right")
            for s, e, lo, hi in zip(starts, ends, left, right):
                if hi > lo:
                    found = task({k: v[s:e] for k, v in q.items()}, {k: v[lo:hi] for k, v in c.items()})
                    if len(found[columns[0]]):
                        parts.append(found)
        if not parts:
            return pd.DataFrame({k: [] for k in columns})
        return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in columns})

    return run


def compare(
    queries: DataFrame,
    candidates: DataFrame,
    task: Callable[[Rows, Rows], Rows],
    schema: str,
    rows: int = CHUNK_ROWS,
    whole: str = "id",
) -> DataFrame:
    """Run ``task`` on every (query chunk, candidate chunk) of every group.

    Candidates that are equal in the column ``whole`` are never dealt to different chunks.

    A task gets and returns columns as arrays (coordinates as the matrix ``x``), so that
    thousands of small groups cost little each. Both frames have ``g`` (long) and ``id`` (long).
    Output per query may come from several chunks; the caller merges it.
    """
    nq = queries.groupBy("g").agg(F.count(F.lit(1)).alias("nq"))
    nc = candidates.groupBy("g").agg(F.count(F.lit(1)).alias("nc"))
    sizes = cut_lineage(nq.join(nc, "g"))
    # a row is copied for every chunk it meets, so larger chunks make fewer copies
    met = {r: F.col("nq") * F.ceil(F.col("nc") / r) + F.col("nc") * F.ceil(F.col("nq") / r) for r in (rows, LARGER * rows)}
    sums = {"t": F.col("nq") + F.col("nc"), **{f"m{r}": copies for r, copies in met.items()}}
    total = sizes.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()]).first()
    if total[f"m{rows}"] > MOVED_ROWS:
        rows *= LARGER
    passes = max(1, -(-int(total[f"m{rows}"]) // MOVED_ROWS))
    packs = max(1, -(-int(total["t"]) // rows))
    small = (F.col("nq") <= SMALL_GROUP) & (F.col("nc") <= SMALL_GROUP)
    plan = sizes.select(
        "g",
        F.when(small, F.pmod(F.xxhash64("g"), F.lit(packs))).otherwise(F.col("g")).alias("pack"),
        small.alias("small"),
        F.ceil(F.col("nq") / rows).cast("int").alias("qk"),
        F.ceil(F.col("nc") / rows).cast("int").alias("ck"),
        F.pmod(F.xxhash64("g", F.lit(3)), F.lit(passes)).alias("turn"),
    )
    # fresh column identities, or the cogroup below could not tell the two sides apart
    again = plan.select("g", *[F.col(c).alias(c) for c in ("pack", "small", "qk", "ck", "turn")])
    if total["n"] <= BROADCAST_GROUPS:
        plan, again = F.broadcast(plan), F.broadcast(again)
    chunk, chunk_c = F.xxhash64("id", F.lit(17)), F.xxhash64(whole, F.lit(17))
    keys = ["small", "pack", "qc", "cc"]
    columns = [field.strip().split(" ")[0] for field in schema.split(",")]
    keyed_q = queries.join(plan, "g").withColumn("qc", F.pmod(chunk, F.col("qk")).cast("int"))
    keyed_c = candidates.select(*[F.col(c).alias(c) for c in candidates.columns]).join(again, "g").withColumn("cc", F.pmod(chunk_c, F.col("ck")).cast("int"))

    def one(turn: int) -> DataFrame:
        def dealt(df: DataFrame, own: str, other: str, count: str) -> DataFrame:
            """A copy per chunk of the other side that this pass compares it with."""
            chunks = F.sequence(F.lit(0), F.col(count) - 1)
            if passes > 1:
                chunks = F.filter(chunks, lambda v: F.pmod(F.col("turn") + F.col(own) + v, F.lit(passes)) == turn)
            return df.withColumn(other, F.explode(chunks)).drop("qk", "ck", "turn")

        left, right = dealt(keyed_q, "qc", "cc", "ck"), dealt(keyed_c, "cc", "qc", "qk")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_packed(task, columns), schema)

    if passes == 1:
        return one(0)
    # stored pass by pass, so that the copies of one are gone before the next
    return reduce(DataFrame.unionAll, [store(one(turn)) for turn in range(passes)])
