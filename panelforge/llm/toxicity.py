"""Toxicity by classifier chains.

Categories are predicted one after the other. The linear model of a category sees the text's
features and the probabilities of all earlier categories; while fitting, those probabilities
are out-of-fold predictions, so a later model does not trust an earlier one more than it will
be worth on new texts.

Features are the distinct words of a text and their first 4, 5 and 6 letters, which catches
inflected forms. The features that speak most clearly for the last category are selected by a G-test on
the labelled sample; features that speak against it are left out, so harmless words around an
insult do not excuse it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import store

#: Labelled rows used for fitting, for each value of the last category.
SAMPLE_PER_CLASS = 8_000
FEATURES = 1_024
MIN_DOCS = 3
#: Least G-statistic (in nats) of a selected feature.
MIN_GAIN = 10.0
FOLDS = 4
STEPS = 150
RIDGE = 0.02
THRESHOLD = 0.5
#: Features that a task counts before it sends them on.
FLUSH = 400_000
PREFIXES = (4, 5, 6)
STRIP = ".,;:!?\"'()[]{}<>#$%&*|-_/\\"


def text_features(text: str) -> set[str]:
    """Distinct words without punctuation around them, lower-cased, and their prefixes (marked ``~``)."""
    words = {w.strip(STRIP) for w in text.lower().split()}
    words.discard("")
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "~" for w in words if len(w) >= n])
    return out


@dataclass
class Linear:
    """One model of the chain: weights of the selected features, then of the earlier categories."""

    weights: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: list[str]
    features: list[str]
    models: list[Linear]

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Probability per row and category from the (row, feature) positions that are present."""
        out = np.zeros((n, len(self.categories)))
        for j, m in enumerate(self.models):
            out[:, j] = _predict(m, rows, cols, n, out[:, :j])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _predict(m: Linear, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    k = len(m.weights) - earlier.shape[1]
    z = np.bincount(rows, weights=m.weights[cols], minlength=n) + m.bias
    return _sigmoid(z + earlier @ m.weights[k:])


def _fit(rows: np.ndarray, cols: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, steps: int, ridge: float) -> Linear:
    """Ridge logistic regression on sparse 0/1 features by Adam on the whole sample."""
    n, total = len(y), weight.sum()
    w, b = np.zeros(k + earlier.shape[1]), 0.0
    share = np.clip((weight * y).sum() / max(total, 1e-9), 1e-4, 1 - 1e-4)
    b = float(np.log(share / (1 - share)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b + earlier @ w[k:]
        err = weight * (_sigmoid(z) - y)
        g = np.r_[np.bincount(cols, weights=err[rows], minlength=k), earlier.T @ err, err.sum()] / total
        g[:-1] += ridge / max(n, 1) * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.2 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        b -= float(step[-1])
    return Linear(w, b)


def fit_chain_arrays(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, categories: Sequence[str], features: Sequence[str],
    folds: int = FOLDS, steps: int = STEPS, ridge: float = RIDGE,
) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities of every category."""
    n, k = len(y), len(features)
    fold = np.arange(n) % folds
    held = np.zeros((n, len(categories)))
    models = []
    for j in range(len(categories)):
        earlier = held[:, :j]
        models.append(_fit(rows, cols, earlier, y[:, j], weight, k, steps, ridge))
        for f in range(folds):
            out = fold == f
            rest = np.where(out, 0.0, weight)
            if rest.sum() > 0:
                held[out, j] = _predict(_fit(rows, cols, earlier, y[:, j], rest, k, steps, ridge), rows, cols, n, earlier)[out]
    return Chain(list(categories), list(features), models), held


def _feature_counts(sample: DataFrame, last: str) -> DataFrame:
    """(feature, n, n1): texts with the feature, and those of them in the last category; counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        positive: Counter = Counter()

        def out():
            counts = [list(every.values()), [positive[f] for f in every]]
            return pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), *[pa.array(c, pa.int64()) for c in counts]], ["feature", "n", "n1"])

        for batch in batches:
            for i in range(batch.num_rows):
                found = text_features(batch.column(1)[i].as_py() or "")
                every.update(found)
                if batch.column(0)[i].as_py() == 1.0:
                    positive.update(found)
                if len(every) > FLUSH:
                    yield out()
                    every.clear()
                    positive.clear()
        yield out()

    rows = sample.select(F.col(last), F.col("text")).mapInArrow(run, "feature string, n long, n1 long")
    return rows.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def _with_hits(sample: DataFrame, categories: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """(id, share, categories..., hits): positions of the chosen features that every text has."""
    where = {f: i for i, f in enumerate(chosen)}
    kept = ["id", "share", *categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            hits = [sorted(where[f] for f in text_features(texts[i].as_py() or "") if f in where) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(hits, pa.list_(pa.int32()))], [*kept, "hits"])

    numbers = ", ".join(f"`{c}` double" for c in kept[1:])
    frame = sample.select("id", *[F.col(c).cast("double").alias(c) for c in kept[1:]], "text")
    return frame.mapInArrow(run, f"id long, {numbers}, hits array<int>")


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, categories..., share): at most ``per_class`` distinct texts for each value of the last category.

    Rows are drawn in hash order. Texts that have copies count once, so a group of copies does
    not teach its own words. ``share`` is what part of the class was drawn.
    """
    last = categories[-1]
    known = labels.where(F.col(last).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        *[F.coalesce(F.max(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in categories]
    )
    sizes = {r[last]: r["n"] for r in known.groupBy(last).agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for value in (0.0, 1.0):
        drawn = known.where(F.col(last) == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = drawn if picked is None else picked.unionAll(drawn)
    picked = F.broadcast(store(picked))  # at most 2 * per_class rows of numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, F.col("id") == F.col("_id")).drop("_id")
    copy = Window.partitionBy(F.xxhash64("text")).orderBy("id", *categories)
    rows = rows.withColumn("_copy", F.row_number().over(copy)).where("_copy = 1").drop("_copy")
    share = F.when(F.col(last) == 1.0, min(1.0, per_class / max(sizes.get(1.0, 1), 1))).otherwise(min(1.0, per_class / max(sizes.get(0.0, 1), 1)))
    return rows.withColumn("share", share)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = SAMPLE_PER_CLASS,
    features: int = FEATURES,
    min_docs: int = MIN_DOCS,
) -> Chain:
    """Fit the chain for ``categories`` (0/1 columns of ``labels`` beside ``doc_id``), in their order.

    The sample is bounded by ``per_class``, the model by ``features``. NULL labels of the last
    category are left out, other NULL labels count as 0. Without labelled rows the chain has no
    features and rejects nothing.
    """
    sample = labelled_sample(docs, labels, categories, per_class, id_col, text_col)
    sample = store(sample.withColumn("id", F.monotonically_increasing_id()))
    last = categories[-1]
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(last).alias("n1")).first()
    if not size["n"]:
        return Chain(list(categories), [], [Linear(np.zeros(j), -20.0) for j in range(len(categories))])
    counts = store(_feature_counts(sample, last).where(F.col("n") >= min_docs))
    total, total1 = float(size["n"]), float(size["n1"])

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    rest = max(total - total1, 1e-9)
    table = [(n1, n * (total1 / total)), (n - n1, n * (rest / total)), (total1 - n1, (total - n) * (total1 / total)), (rest - (n - n1), (total - n) * (rest / total))]
    g = sum((part(o, F.greatest(e, F.lit(1e-9))) for o, e in table[1:]), part(table[0][0], F.greatest(table[0][1], F.lit(1e-9))))
    speaks = n1 * total > n * total1
    best = counts.where(speaks).select("feature", g.alias("g")).where(F.col("g") >= MIN_GAIN).orderBy(F.desc("g"), "feature").limit(features)
    chosen = [r["feature"] for r in best.collect()]  # at most ``features`` rows
    rows = _with_hits(sample, categories, chosen).repartition(1)
    names = list(categories)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one task, which holds at most 2 * per_class rows of at most ``features`` numbers
        all_ = pd.concat(list(batches)).sort_values("id")
        of = [h if h is not None else [] for h in all_["hits"]]
        at = np.repeat(np.arange(len(of)), np.array([len(h) for h in of], dtype=np.int64))
        cols = np.concatenate([np.asarray(h, dtype=np.int64) for h in of])
        y, weight = all_[names].to_numpy(dtype=float), 1.0 / all_["share"].to_numpy(dtype=float)
        chain, _ = fit_chain_arrays(at, cols, y, weight, names, chosen)
        yield pd.DataFrame({"at": range(len(names)), "weights": [m.weights for m in chain.models], "bias": [m.bias for m in chain.models]})

    models = rows.mapInPandas(train, "at int, weights array<double>, bias double").orderBy("at").collect()
    return Chain(names, chosen, [Linear(np.array(m["weights"], dtype=float), m["bias"]) for m in models])


def _batch_probabilities(model: Chain, where: dict[str, int], texts: pa.Array) -> np.ndarray:
    n = len(texts)
    hits = [[where[f] for f in text_features(texts[i].as_py() or "") if f in where] for i in range(n)]
    rows = np.repeat(np.arange(n), np.array([len(h) for h in hits], dtype=np.int64))
    cols = np.array([c for h in hits for c in h], dtype=np.int64)
    return model.probabilities(rows, cols, n)


def score_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, p_<category>..., rejected): one row per row of ``docs``.

    ``rejected`` is decided on the last category. A NULL or empty text has no features. Repeated
    rows stay and are scored alike, a NULL id is kept, other columns are ignored, an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        where = {f: i for i, f in enumerate(model.features)}
        for batch in batches:
            p = _batch_probabilities(model, where, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, j]) for j in range(len(names))]], [id_col, *names])

    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return scored.withColumn("rejected", F.col(names[-1]) >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, with all their columns; decided batch by batch, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        where = {f: i for i, f in enumerate(model.features)}
        for batch in batches:
            last = _batch_probabilities(model, where, batch.column(at))[:, -1]
            yield batch.filter(pa.array(last < threshold))

    return docs.mapInArrow(run, docs.schema)
