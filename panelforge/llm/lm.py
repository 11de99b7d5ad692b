"""Log-bilinear language model trained with noise-contrastive estimation.

The model predicts the class of a token from the class of the token before it. The most frequent
tokens are classes of their own; every other token belongs to the class of its last bytes. With a
vector ``r`` per class, the score of class ``w`` after ``c`` is ``(r_c C) . r_w + b_w``; a token
inside its class has its smoothed share of the class's training tokens. Both factors are
normalised, so a text has a proper probability.

Counts and neighbouring pairs of classes are gathered over all training texts; pairs are the
model's sufficient statistics, bounded by the square of the number of classes. Training runs on
them in NumPy with matrix products: the data term of the noise-contrastive objective is summed
over the pairs seen, the noise term is its exact expectation. Scoring turns the parameters into a
table of normalised log probabilities by one matrix product in each task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import most_frequent

WORDS = 1_024
ENDINGS = 256
ENDING_BYTES = 3
SIZE = 32
NOISE = 10.0
EPOCHS = 160
RATE = 0.05
#: Tokens whose counts are sent to every task; the counts of all others are joined.
FREQUENT = 200_000
FLUSH = 400_000
FOLD, FOLDS = 2, 7
#: Ends a text; no word is empty.
END = b""


def held_out(doc_id: Column) -> Column:
    """True for the documents that the model does not learn from; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == FOLD


def tokens_of(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, then one end."""
    return [*text.encode().lower().split(), END]


def ending_class(token: bytes) -> int:
    return zlib.crc32(token[-ENDING_BYTES:]) % ENDINGS


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of a frame with one text column; counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                seen.update(tokens_of(batch.column(0)[i].as_py() or ""))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Frequent tokens with their classes and counts, and the totals of every class.

    The first classes are tokens of their own (the end is class 0), the last ``ENDINGS`` are endings.
    """

    index: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    own: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    total: int
    types: int

    @property
    def size(self) -> int:
        return self.own + ENDINGS

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Class of every token."""
        at = np.array([self.index.get(t, -1) for t in tokens], dtype=np.int64)
        out = self.classes[at]
        for i in np.nonzero(at < 0)[0]:
            out[i] = self.own + ending_class(tokens[i])
        return out

    def log_base(self, c):
        return np.log10((c + 1.0) / (self.total + self.types + 1.0))

    def log_inside(self, cls, c):
        """log10 of a token's share of its class; a class that is one token needs none."""
        cls = np.asarray(cls)
        share = np.log10((c + 1.0) / (self.class_tokens[cls] + self.class_types[cls] + 1.0))
        return np.where(cls < self.own, 0.0, share)


def vocabulary(counts: DataFrame, words: int = WORDS, frequent: int = FREQUENT) -> Vocabulary:
    """The bounded part of the counts that every task gets: ``frequent`` tokens and the class totals."""
    top = most_frequent(counts, "c", frequent, "token").select("token", "c").toArrow()  # at most ``frequent`` rows
    known = dict(sorted(zip(top["token"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0])))
    tokens = list(known)
    own = [END, *[t for t in tokens if t != END][: words - 1]]
    own_rows = counts.sparkSession.createDataFrame([(bytearray(t),) for t in own], "token binary")
    ending = F.crc32(F.substring("token", -ENDING_BYTES, ENDING_BYTES)) % ENDINGS
    rest = counts.join(F.broadcast(own_rows), "token", "left_anti").groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    n = len(own)
    class_tokens, class_types = np.zeros(n + ENDINGS), np.zeros(n + ENDINGS)
    for i, t in enumerate(own):
        class_tokens[i], class_types[i] = known.get(t, 0), 1
    for r in rest.collect():  # at most ENDINGS rows
        class_tokens[n + r["e"]], class_types[n + r["e"]] = r["c"], r["v"]
    both = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    place = {t: i for i, t in enumerate(own)}
    names = [*own, *[t for t in tokens if t not in place]]
    classes = np.array([place[t] if t in place else n + ending_class(t) for t in names], dtype=np.int64)
    return Vocabulary({t: i for i, t in enumerate(names)}, classes, np.array([float(known.get(t, 0)) for t in names]), n, class_tokens, class_types, both["n"] or 0, both["v"])


def class_pairs(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """(pair, n): how often class ``pair % size`` follows class ``pair // size``; texts start after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        total, held, waiting = np.zeros(v.size * v.size, dtype=np.int64), [], 0

        def add():
            if held:
                np.add(total, np.bincount(np.concatenate(held), minlength=len(total)), out=total)

        for batch in batches:
            for i in range(batch.num_rows):
                cls = v.ids(tokens_of(batch.column(0)[i].as_py() or ""))
                held.append(np.r_[0, cls[:-1]] * v.size + cls)
                waiting += len(cls)
                if waiting > 1_000_000:
                    add()
                    held, waiting = [], 0
        add()
        pairs = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], ["pair", "n"])

    return texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    r: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of every class (column) after every class (row)."""
        s = (self.r @ self.c) @ self.r.T + self.b
        top = s.max(axis=1, keepdims=True)
        return (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / np.log(10.0)


def train(pairs: np.ndarray, n: np.ndarray, size: int, dims: int = SIZE, noise: float = NOISE, epochs: int = EPOCHS, rate: float = RATE) -> LogBilinear:
    """Noise-contrastive estimation from the counts of class pairs, by Adam on whole-data gradients."""
    seen = np.zeros(size * size, dtype=np.float32)
    seen[pairs] = n
    seen = seen.reshape(size, size)
    total = max(float(seen.sum()), 1.0)
    unigram = (seen.sum(axis=0) + 1.0) / (total + size)
    seen /= total
    expected = noise * seen.sum(axis=1, keepdims=True) * unigram  # noise drawn after each context
    base = np.log(noise * unigram).astype(np.float32)
    rng = np.random.default_rng(11)
    model = LogBilinear((0.3 * rng.standard_normal((size, dims))).astype(np.float32), np.zeros((dims, dims), dtype=np.float32), np.log(unigram).astype(np.float32))
    names = ("r", "c", "b")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    for t in range(1, epochs + 1):
        rc = model.r @ model.c
        real = 1.0 / (1.0 + np.exp(np.clip(base - model.b - rc @ model.r.T, -30, 30)))
        g = (seen + expected) * real - seen  # gradient of the loss by the score
        grads = {"r": g @ (model.r @ model.c.T) + g.T @ rc, "c": model.r.T @ (g @ model.r), "b": g.sum(axis=0)}
        step = rate * (0.5 if t > epochs // 2 else 1.0) * (0.4 if t > epochs * 4 // 5 else 1.0)
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
            change = step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
            setattr(model, k, (getattr(model, k) - change).astype(np.float32))
    return model


def fit(counts: DataFrame, texts: DataFrame, words: int = WORDS, frequent: int = FREQUENT) -> tuple[Vocabulary, LogBilinear]:
    """Vocabulary and model from the stored counts and the training texts (one text column)."""
    v = vocabulary(counts, words, frequent)
    pairs = class_pairs(texts, texts.sparkSession.sparkContext.broadcast(v))
    size = v.size

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at most the square of the classes, whatever the number of texts
        found = pa.Table.from_batches(list(batches), schema=pa.schema([("pair", pa.int32()), ("n", pa.int64())]))
        m = train(found["pair"].to_numpy().astype(np.int64), found["n"].to_numpy(), size)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.r, m.c, m.b)], ["r", "c", "b"])

    row = pairs.repartition(1).mapInArrow(one_task, "r binary, c binary, b binary").first()
    if row is None:  # no training text
        return v, train(np.empty(0, dtype=np.int64), np.empty(0), size)
    r, c, b = (np.frombuffer(bytes(x), dtype=np.float32) for x in row)
    return v, LogBilinear(r.reshape(size, -1), c.reshape(-1, r.size // size), b)


def _partly_scored(docs: DataFrame, id_col: str, text_col: str, v: Vocabulary, model: LogBilinear) -> DataFrame:
    """Sums over the frequent tokens of every document, and its other tokens with their classes."""
    shared = docs.sparkSession.sparkContext.broadcast((v, model))
    rare = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("cls", T.IntegerType())]))
    sums = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *sums, T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        table = model.log10_table()
        log_base, log_inside = v.log_base(v.counts), v.log_inside(v.classes, v.counts)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            flat: list[list] = [[], [], []]
            ends = [0]
            for i in range(batch.num_rows):
                tokens = tokens_of(batch.column(1)[i].as_py() or "")
                at = np.array([v.index.get(t, -1) for t in tokens], dtype=np.int64)
                cls = v.classes[at]
                known = at >= 0
                other: Counter = Counter()
                for j in np.nonzero(~known)[0]:
                    cls[j] = v.own + ending_class(tokens[j])
                    other[tokens[j], int(cls[j])] += 1
                at = at[known]
                out[0].append(len(tokens))
                out[1].append(int((v.counts[at] > 0).sum()))
                out[2].append(float(log_base[at].sum()))
                out[3].append(float(table[np.r_[0, cls[:-1]], cls].sum(dtype=np.float64) + log_inside[at].sum()))
                flat[0] += [k[0] for k in other]
                flat[1] += other.values()
                flat[2] += [k[1] for k in other]
                ends.append(len(flat[0]))
            items = pa.StructArray.from_arrays([pa.array(flat[0], pa.binary()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int32())], ["token", "n", "cls"])
            columns = [batch.column(0), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, frequent: int = FREQUENT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    The model learns from all rows that are not held out and scores all rows; ``base_score`` is
    the add-one unigram score. A NULL text counts as empty and is scored as one end. A NULL id
    counts as an empty text in the fold. Repeated rows stay; other columns are ignored; an empty
    table gives no rows; without training rows every token is unseen.
    """
    training = docs.where(~held_out(F.col(id_col))).select(F.col(text_col))
    counts = store(token_counts(training))
    v, model = fit(counts, training, words, frequent)
    part = store(_partly_scored(docs, id_col, text_col, v, model).withColumn("uid", F.monotonically_increasing_id()))
    rare = part.select("uid", F.explode("rare").alias("r")).select("uid", "r.token", "r.n", "r.cls")
    spark = docs.sparkSession
    classes = spark.createDataFrame([(i, float(v.class_tokens[i] + v.class_types[i] + 1.0)) for i in range(v.own, v.size)], "cls int, room double")
    c = F.coalesce("c", F.lit(0))
    added = (
        rare.join(counts, "token", "left")
        .join(F.broadcast(classes), "cls")
        .groupBy("uid")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(v.total + v.types + 1)))).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + 1) / F.col("room"))).alias("more_score"),
        )
    )
    more = lambda name: F.coalesce(name, F.lit(0))
    return part.drop("rare").join(added, "uid", "left").select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + more("known")).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"),
        (F.col("score") + more("more_score")).alias("score"),
    )
