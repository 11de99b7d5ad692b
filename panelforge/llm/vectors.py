"""Near-dedup of embeddings by small-world graphs per shard.

Equal vectors are one class with a count. Classes are dealt to shards by hash; each shard is one
task, which first reads its own vectors and builds its graph, then streams all query vectors
through it in batches, so it holds one shard and one batch at a time. A query whose whole beam
lies within the threshold is searched again with a wider one. The first queries of every shard are
an audit of bounded size, drawn by hash: they are compared with the whole shard, and while the
recall of any of them, itself left out, is below the wanted one, the shard's beam is doubled. Nodes
that a search for their own vector misses are compared with every query. What
the widest beam does not settle is compared with the whole shard by block matrix products: queries
whose beam is still full or ran out of reachable nodes, and after a failed audit all queries.

Candidates near the threshold are verified by cosine in double precision. A task sends counts of links and a
spanning forest of the links it saw, never all pairs, and components are united from those.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import store
from .hnsw import Hnsw

LOG = logging.getLogger(__name__)
THRESHOLD = 0.95
SHARDS = 12
SHARD_ROWS = 50_000
BEAM = 32
RECALL = 0.99
#: Queries that every shard is audited with, about; a table with fewer rows is audited whole.
AUDITS = 2_048
QUERIES = 2_048
#: Beyond this beam the whole shard is compared, which costs less.
WIDEST = 256
#: Cells of a block of similarities.
CELLS = 4_000_000
#: Single precision is off by less than this.
MARGIN = 1e-4


def usable(vector: Column) -> Column:
    """True for a vector of finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Shard:
    """The classes of one shard and the links found in it."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float, beam: int, recall: float):
        self.ids, self.copies, self.x = ids, copies, vectors
        self.x32 = vectors.astype(np.float32)
        self.graph = Hnsw(self.x32)
        self.parent = np.arange(len(ids))
        self.threshold, self.beam, self.recall = threshold, beam, recall
        self.exact = False
        self.hidden: np.ndarray | None = None
        self.audited = np.zeros(2, dtype=np.int64)  # links of audited queries, and those the graph found

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        """Root of every node, with the paths made shorter."""
        root = self.parent[nodes]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        self.parent[nodes] = root
        return root

    def _linked(self, ids: np.ndarray, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate positions those that link, without a query itself."""
        near = (sims >= self.threshold + MARGIN) & (ids[rows] != self.ids[nodes])
        close = np.nonzero((np.abs(sims - self.threshold) < MARGIN) & (ids[rows] != self.ids[nodes]))[0]
        step = max(1, CELLS // self.x.shape[1])
        for at in range(0, len(close), step):
            some = close[at : at + step]
            near[some] = np.einsum("ij,ij->i", q[rows[some]], self.x[nodes[some]]) >= self.threshold
        return rows[near], nodes[near]

    def _compare(self, ids: np.ndarray, q: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of the ``asked`` queries with the whole shard, by blocks of queries in order."""
        step = max(1, CELLS // len(self.ids))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            sims = q[some].astype(np.float32) @ self.x32.T
            r, c = np.nonzero(sims >= self.threshold - MARGIN)
            yield self._linked(ids, q, some[r], c, sims[r, c])

    def _candidates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) positions that the graph holds to be near, their similarities, and the queries it cannot settle."""
        rows, nodes, near_sims, unsettled, open_, beam = [], [], [], [], np.arange(len(q)), self.beam
        while len(open_):
            wide = min(beam, len(self.ids))
            found, sims = self.graph.search(q[open_], wide)
            near = (found >= 0) & (sims >= self.threshold - MARGIN)
            # an empty slot means that the walk met no more nodes, though the shard has more
            lost = (found < 0).any(axis=1)
            full = near.all(axis=1) & (wide < len(self.ids))
            r, c = np.nonzero(near & ~(full | lost)[:, None])
            rows.append(open_[r])
            nodes.append(found[r, c])
            near_sims.append(sims[r, c])
            if 4 * beam > WIDEST:
                lost |= full
            unsettled.append(open_[lost])
            open_, beam = open_[full & ~lost], 4 * beam
        return tuple(np.concatenate(x) for x in (rows, nodes, near_sims, unsettled))

    def _hidden(self) -> np.ndarray:
        """Nodes that not even their own vectors lead to at the present beam; every query is compared with them."""
        if self.hidden is None:
            lost = []
            for at in range(0, len(self.ids), QUERIES):
                found, _ = self.graph.search(self.x32[at : at + QUERIES], min(self.beam, len(self.ids)))
                own = at + np.arange(len(found))
                lost.append(own[~(found == own[:, None]).any(axis=1)])
            self.hidden = np.concatenate(lost)
        return self.hidden

    def _found(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) positions of links by the graph and by the nodes hidden from it, and the queries it cannot settle."""
        q32 = q.astype(np.float32)
        rows, nodes, sims, unsettled = self._candidates(q32)
        hidden = self._hidden()
        seen = ~np.isin(nodes, hidden)
        near = q32 @ self.x32[hidden].T
        near[unsettled] = -1.0  # these are compared with the whole shard
        r, c = np.nonzero(near >= self.threshold - MARGIN)
        rows, nodes, sims = np.r_[rows[seen], r], np.r_[nodes[seen], hidden[c]], np.r_[sims[seen], near[r, c]]
        return *self._linked(ids, q, rows, nodes, sims), unsettled

    def _audit(self, ids: np.ndarray, q: np.ndarray, true: np.ndarray) -> None:
        """Widen the beam until the graph finds enough of the ``true`` links of every query, or give the graph up."""
        everyone = np.arange(len(q))
        while not self.exact:
            rows, _, unsettled = self._found(ids, q)
            seen = np.bincount(rows, minlength=len(q))
            judged = np.setdiff1d(everyone, unsettled)
            if (seen[judged] >= self.recall * true[judged]).all():
                self.audited += np.array([true[judged].sum(), seen[judged].sum()])
                return
            # the graph may hide links from any beam
            self.exact = 2 * self.beam > WIDEST
            self.beam *= 2
            self.hidden = None

    def links(self, ids: np.ndarray, q: np.ndarray, audited: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified (query, node) positions of a batch of queries, without a query itself; all of a query come together."""
        if audited or self.exact:
            true = np.zeros(len(q), dtype=np.int64)
            for rows, nodes in self._compare(ids, q, np.arange(len(q))):
                true += np.bincount(rows, minlength=len(q))
                yield rows, nodes
            if audited:
                self._audit(ids, q, true)
            return
        rows, nodes, unsettled = self._found(ids, q)
        yield rows, nodes
        yield from self._compare(ids, q, np.sort(unsettled))

    def report(self, ids: np.ndarray, q: np.ndarray, audited: bool = True) -> pa.RecordBatch:
        """(u, v, links): a spanning forest of the batch's links; a query's count comes with its first edge."""
        u, v, n = [], [], []
        for rows, nodes in self.links(ids, q, audited):
            order = np.argsort(rows, kind="stable")
            rows, nodes = rows[order], nodes[order]
            count = np.bincount(rows, weights=self.copies[nodes], minlength=len(q)).astype(np.int64)
            asked, start = np.unique(rows, return_index=True)
            for r, near in zip(asked.tolist(), np.split(nodes, start[1:])):
                roots, first = np.unique(self._roots(near), return_index=True)
                self.parent[roots] = roots[0]
                for k, c in enumerate(near[first].tolist()):
                    u.append(ids[r]), v.append(self.ids[c]), n.append(0 if k else count[r])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "links"])


def _search(classes: DataFrame, n: int, shards: int, threshold: float, beam: int, recall: float, audits: int) -> DataFrame:
    """(u, v, links) from (cid, dims, copies, vector); classes of other length are never compared.

    A row with ``u`` -1 is a shard's audit: links of the audited queries, and those the graph found.
    """
    sizes = [r["dims"] for r in classes.select("dims").distinct().orderBy("dims").collect()]  # lengths of vectors in use
    at = F.array_position(F.array(*[F.lit(x) for x in sizes]), F.col("dims")).cast("int") - 1
    base = classes.withColumn("first", at * shards)
    own = base.select((F.col("first") + F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")).alias("shard"), F.lit(0).alias("kind"), "cid", "copies", "vector")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.lit(shards - 1)))
    drawn = F.pmod(F.xxhash64("cid", F.lit(29)), F.lit(n)) < audits
    asked = base.select(every.alias("shard"), F.when(drawn, 1).otherwise(2).alias("kind"), "cid", "copies", "vector")
    dealt = own.unionAll(asked).repartitionById(shards * len(sizes), F.col("shard")).sortWithinPartitions("shard", "kind", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, parts = None, None, []

        def audit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, *shard.audited.tolist())], ["u", "v", "links"])

        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                part = batch.slice(start, QUERIES)
                of, kind = part.column(0).to_numpy(), part.column(1).to_numpy()
                for s in np.unique(of):
                    mine = of == s
                    if s != now:
                        if shard is not None:
                            yield audit()
                        now, shard, parts = s, None, []
                    for k in (0, 1, 2):
                        rows = np.nonzero(mine & (kind == k))[0]
                        if not len(rows):
                            continue
                        taken = part.slice(rows[0], len(rows))  # sorted, so they are together
                        vectors = taken.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                        own_ids, copies = taken.column(2).to_numpy(), taken.column(3).to_numpy()
                        if k == 0:
                            parts.append((own_ids, copies, unit(vectors)))
                            continue
                        if shard is None and parts:
                            shard = _Shard(*(np.concatenate(x) for x in zip(*parts)), threshold, beam, recall)
                            parts = []
                        if shard is not None:
                            yield shard.report(own_ids, unit(vectors), k == 1)
        if shard is not None:
            yield audit()

    return dealt.mapInArrow(run, "u long, v long, links long")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
    recall: float = RECALL,
    audits: int = AUDITS,
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    Rows link when the cosine of their vectors is at least ``threshold``; all rows are compared,
    whatever their other columns say. A vector that is NULL or zero, or holds a NULL or
    non-finite component, links with nothing, not even with an equal one; vectors of different
    length do not link. Repeated rows and equal vectors link with each other. ``component_id``
    is the smallest id reachable over links, itself included; ``kept`` tells whether it is the
    row's own. A NULL id is kept as NULL and never the smallest. An empty table gives no rows.

    A graph holds at most about ``shard_rows`` classes, so shards grow with the table; every
    query visits every shard. About ``audits`` queries are compared with every shard whole; the
    recall they saw at the end is logged. A hidden link of 1 in 1,000 queries would be met by such
    an audit with a chance of 87 %.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("usable", usable(F.col("vector")))
    good = rows.where("usable").select("id", "vector")
    classes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = store(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("vector").alias("dims"), "copies", "least", "vector"))
    n = classes.count()
    if n:
        reported = store(_search(classes, n, max(shards, -(-n // shard_rows)), threshold, beam, recall, audits))
        found = reported.where("u >= 0")
        seen = reported.where("u < 0").agg(F.sum("v").alias("true"), F.sum("links").alias("met")).first()
        LOG.info("audited links: %s, found by the graphs: %s", seen["true"], seen["met"])
    else:
        found = vectors.sparkSession.createDataFrame([], "u long, v long, links long")
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    parts = store(connected_components(classes.select(F.col("cid").alias("id")), found.select("u", "v")))
    named = classes.join(parts, F.col("cid") == F.col("id")).select("cid", "least", "component")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = (
        named.join(smallest, "component")
        .join(counts, F.col("cid") == F.col("u"), "left")
        .select("cid", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
    full = classes.select("cid", "copies", F.col("vector").alias("_vector")).join(of_class, "cid")
    joined = rows.join(full, F.col("usable") & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
