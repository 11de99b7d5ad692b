"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

What a term adds to a document's score, its impact, depends on the document and on corpus totals
only. Every task cuts its documents into shards of bounded size and keeps, for each term, the
shard's documents in falling order of impact. For an item the lists of its terms are read block by
block. A document met so far has a lower bound, the impacts read, and an upper bound, which adds
the last impact read of every list that has not shown it. Documents whose upper bound is below the
k-th largest lower bound leave; a document not met yet can only matter while the last impacts
together reach that bound. Reading goes on until the bounds of all documents left meet, so that
membership, ties and scores are final. The k-th best score of a task's earlier shards is the
starting bound of its next one.

Tasks send at most k rows an item, which are merged in two steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import store
from .common import side

TOP = 20
#: Bytes of item texts whose terms are sent to every task at a time; further items take another pass.
ITEM_BYTES = 8 * 1024 * 1024
#: (document, term) rows of a shard.
SHARD_ROWS = 2_000_000
FIRST_READ = 64
#: Groups in which the rows of an item are merged first.
MERGES = 64

# Term bytes: digits, letters and all of UTF-8 beyond ASCII; A-Z become a-z, all others separate terms.
_TERM_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Items:
    """Terms of a block of items: their ids, and for every item its term ids and how often it has them."""

    terms: dict[bytes, int]
    numbers: list[int]
    wanted: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows) -> Items:
        terms: dict[bytes, int] = {}
        numbers, wanted = [], []
        for r in rows:
            found = Counter(terms_of((r["text"] or "").encode()))
            if found:
                ids = [terms.setdefault(t, len(terms)) for t in found]
                numbers.append(r["no"])
                wanted.append((np.array(ids), np.array(list(found.values()), dtype=np.int64)))
        return cls(terms, numbers, wanted)


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2n + 2) / (2 df + 1))) per term."""
    return np.floor(1000.0 * np.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, in whole numbers; ``length`` counts the document's terms."""
    m = 75 + (25 * length * n) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Impact-sorted lists of the documents 0, 1, ... of a shard."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        self.slot = np.full(docs, -1, dtype=np.int64)  # place among the candidates of the current item

    def best(self, ids: np.ndarray, times: np.ndarray, k: int, floor: int = 0, first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that score at least the k-th best, at least ``floor`` and above 0."""
        lo, hi = self.start[ids], self.start[ids + 1]
        some = hi > lo
        lo, hi, times = lo[some], hi[some], times[some]
        width = len(lo)
        slot, bar, unmet = self.slot, max(floor, 1), True
        docs, low, met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), bool)
        at, step = lo.copy(), first
        while width:
            end = np.minimum(at + step, hi)
            read = np.concatenate([np.arange(a, e) for a, e in zip(at, end)])
            column = np.repeat(np.arange(width), end - at)
            seen = self.doc[read]
            if unmet:
                fresh = np.unique(seen[slot[seen] < 0])
                slot[fresh] = len(docs) + np.arange(len(fresh))
                docs, low = np.r_[docs, fresh], np.r_[low, np.zeros(len(fresh), np.int64)]
                met = np.r_[met, np.zeros((len(fresh), width), bool)]
            else:
                known = slot[seen] >= 0
                read, column, seen = read[known], column[known], seen[known]
            place = slot[seen]
            np.add.at(low, place, self.impact[read] * times[column])
            met[place, column] = True
            last = np.where(end < hi, self.impact[np.maximum(end - 1, 0)], 0) * times
            high = low + last.sum() - met @ last
            if len(low) >= k:
                bar = max(bar, int(np.partition(low, len(low) - k)[len(low) - k]))
            unmet = bool(last.sum() >= bar)
            left = high >= bar
            slot[docs] = -1
            docs, low, met = docs[left], low[left], met[left]
            slot[docs] = np.arange(len(docs))
            if not unmet and (low == high[left]).all():
                break
            at, step = end, step * 4
        slot[docs] = -1
        return docs, low


def _postings(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs): length and the block's terms of every document with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            texts, rows, lengths, ends = batch.column(1), [], [], [0]
            terms: list[int] = []
            tfs: list[int] = []
            for i in range(len(texts)):
                words = terms_of(texts[i].as_py() or b"")
                if words:
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    rows.append(i)
                    lengths.append(len(words))
                    terms += found
                    tfs += found.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            kept = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(lengths, pa.int64()), *lists], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def _best_of_tasks(postings: DataFrame, items: Items, weights: np.ndarray, n: int, total: int, k: int, shard_rows: int) -> DataFrame:
    """(no, doc, score, task): at most ``k`` rows for every item and task."""
    shared = postings.sparkSession.sparkContext.broadcast((items.numbers, items.wanted, weights))
    schema = T.StructType([T.StructField("no", T.LongType()), postings.schema["doc"], T.StructField("score", T.LongType())])
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wanted, weight = shared.value
        best_doc = [np.empty(0, np.int64)] * len(numbers)  # ids; the largest number stands for NULL
        best_score = [np.empty(0, np.int64)] * len(numbers)
        null = np.iinfo(np.int64).max
        held: list[pa.RecordBatch] = []

        def search() -> None:
            ids = np.concatenate([b.column(0).cast(kind).fill_null(null).to_numpy(zero_copy_only=False) for b in held])
            sizes = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held])
            length = np.concatenate([b.column(1).to_numpy() for b in held])
            term = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column(3).flatten().to_numpy() for b in held]).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            shard = Shard(term, doc, impacts(weight[term], tf, length[doc], n, total), len(ids), len(weight))
            for i, (its, times) in enumerate(wanted):
                floor = int(best_score[i][-1]) if len(best_score[i]) >= k else 0
                found, score = shard.best(its, times, k, floor)
                if len(found):
                    d, s = np.r_[best_doc[i], ids[found]], np.r_[best_score[i], score]
                    first = np.lexsort((d, -s))[:k]
                    best_doc[i], best_score[i] = d[first], s[first]

        waiting = 0
        for batch in batches:
            size = len(batch.column(2).flatten())
            if held and waiting + size > shard_rows:
                search()
                held, waiting = [], 0
            held.append(batch)
            waiting += size
        if held:
            search()
        number = np.repeat(np.array(numbers, dtype=np.int64), [len(s) for s in best_score])
        ids = np.concatenate([*best_doc, np.empty(0, np.int64)])
        out = pa.array(ids, kind, mask=ids == null).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(number), out, pa.array(np.concatenate([*best_score, np.empty(0, np.int64)]))], schema.names)

    return postings.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def _first(df: DataFrame, keys: list, k: int, out: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return df.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents of every row of ``items``, scores above 0 only.

    Equal scores come by ascending whole-numbered id, NULL last. Every row is a document and every
    row of ``items`` an item of its own, so repeated rows are ranked beside each other. NULL and
    empty texts have no terms: such a document counts nowhere, such an item has no rows. Other
    columns are ignored; without documents or items there are no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    rows = store(rows.withColumn("no", F.monotonically_increasing_id()))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(size) // item_bytes))
    best = None
    for b in range(blocks):
        block = Items.of(rows.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).select("no", "text").collect())  # about item_bytes
        postings = store(_postings(docs, block, "doc", "text"))
        sums = postings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        counted = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(block.terms), dtype=np.int64)  # a row per term of the block
        df[counted["t"].to_numpy()] = counted["df"].to_numpy()
        found = _best_of_tasks(postings, block, term_weights(df, sums["n"]), sums["n"], max(sums["l"], 1), k, shard_rows)
        best = found if best is None else best.unionAll(found)
    merged = _first(best, ["no", F.pmod("task", F.lit(MERGES))], k, "rank").drop("rank", "task")
    ranked = _first(merged, ["no"], k, "rank")
    names = side(rows.select("no", "item"), F.octet_length(F.col("item").cast("string")))
    return ranked.join(names, "no").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
