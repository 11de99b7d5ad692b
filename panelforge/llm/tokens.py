"""Token counts by a two-tier lookup on the map side.

Each task first summarises the pre-tokens it reads in a counter of bounded size; the summaries
(at most ``frequent`` rows a task) give a compact table of the lengths, in tokens, of frequent
pre-tokens, which is broadcast. The counting pass then looks every pre-token up in that table,
and in a bounded cache of the task for the rest, which the library encodes once. The stream of
pre-tokens itself is never shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import store
from .common import most_frequent
from .vocabulary import BYTE_BPE, default_path, has_new, library_classes, vocabulary_json

FREQUENT = 16_384
CACHE_ENTRIES = 400_000

_pieces = regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The pieces that a byte-level vocabulary encodes one by one."""
    if has_new(text):
        return [text[m.start() : m.end()] for m in _pieces.finditer(library_classes(text))]
    return _pieces.findall(text)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    values = batch.column(column)
    for i in range(len(values)):
        yield values[i].as_py() or ""


def frequent_pre_tokens(texts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(piece, n): the most frequent pre-tokens by the tasks' bounded summaries.

    A pre-token that a task dropped as rare may be undercounted; this only moves it to the second tier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in _texts(batch, 0):
                seen.update(pre_tokens(text))
                if len(seen) > 16 * frequent:
                    seen = Counter(dict(seen.most_common(4 * frequent)))
        top = seen.most_common(frequent)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    summed = texts.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return most_frequent(store(summed), "n", frequent, "piece")


class TokenCounter:
    """Counts tokens of whole texts from the broadcast table, a bounded cache and the library."""

    def __init__(self, vocabulary: str, lengths: dict[str, int], cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.library = Tokenizer.from_str(vocabulary)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        longest_first = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if special else None
        self.frequent = lengths
        self.known = dict(lengths)
        self.room = len(lengths) + cache_entries

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        plain = self.special.split(text)
        return len(plain) - 1 + sum(map(self._plain, plain))

    def _plain(self, text: str) -> int:
        pieces = pre_tokens(text)
        known = self.known
        missing = list({p for p in pieces if p not in known})
        if missing:
            if len(known) + len(missing) > self.room:
                known = self.known = dict(self.frequent)
                missing = list({p for p in pieces if p not in known})
            for p, e in zip(missing, self.library.encode_batch(missing, add_special_tokens=False)):
                known[p] = len(e.ids)
        return sum(map(known.__getitem__, pieces))


def count_tokens(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, limit: int = 512
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row per row of ``docs``.

    A NULL text counts as empty: 0 bytes and tokens. A special token inside a text is one token.
    Texts are never cut. Repeated rows stay, a NULL id is kept, other columns are ignored, an
    empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    vocabulary = vocabulary_json(path or default_path(BYTE_BPE))
    counter = TokenCounter(vocabulary, {})
    top = [r["piece"] for r in frequent_pre_tokens(docs.select(F.col(text_col)), frequent).collect()]  # at most ``frequent`` rows
    shared: Broadcast = sc.broadcast((vocabulary, {p: counter(p) for p in top}))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(*shared.value)
        for batch in batches:
            n = pa.array([count(t) for t in _texts(batch, 2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], [id_col, "n_bytes", "n_tokens"])

    sized = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    return sized.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
