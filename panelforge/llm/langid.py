"""Language identification by sparse multinomial logistic regression on character n-grams.

A text is lower-cased, everything but letters becomes one blank, and its n-grams of 2 to 4
characters (blanks at both ends) are hashed into a fixed number of features. A feature weighs
``(1 + ln tf) * idf``, and a text's vector has length 1. Document frequencies are counted over all
training documents. The weights are learnt on a bounded sample by follow-the-regularised-leader
with a learning rate of its own for every weight and an elastic-net penalty, whose first part
keeps weights at exactly zero until they have earned their place. A temperature, fitted on sample
texts that did not train the weights, turns the scores into probabilities that can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import store

BITS = 18
SIZES = (2, 3, 4)
#: Distinct texts the weights and the temperature are fitted on, all languages together.
SAMPLE = 8_000
#: Languages that can be learnt: those with the most documents.
LANGUAGES = 256
#: Every so many-th sample text serves the temperature, not the weights.
CALIBRATE = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
FOLD, FOLDS = 2, 4
UNKNOWN = "und"
#: Characters that are turned into n-grams at a time.
PIECE = 1 << 20
_BLANK = 32


def held_out(doc_id: Column) -> Column:
    """True for the documents that the model does not learn from; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == FOLD


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters is one blank, and so is each end."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4")
    code = np.where(_letters()[code], code, _BLANK)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)
    return code[keep]


def _hashed(code: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Feature of the n-gram that starts at each position."""
    h = np.full(len(code) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ code[i : len(code) - size + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(np.r_[first, len(key)])


def term_counts(texts: Sequence[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, tf), sorted by text and feature; many short texts share one sort, a long one takes several."""
    found: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    tfs: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if found:
            key, tf = _counted(np.concatenate(found))
            keys.append(key)
            tfs.append(tf)
            found.clear()
            waiting = 0

    reach = max(SIZES) - 1
    for i, text in enumerate(texts):
        code = _codes(text)
        if len(code) < 2 or (code == _BLANK).all():
            continue
        for at in range(0, len(code), PIECE):
            part = code[at : at + PIECE + reach]
            for size in SIZES:
                if len(part) >= size:
                    found.append(_hashed(part, size, bits)[:PIECE] + (i << bits))
            waiting += len(part)
            if waiting >= PIECE:
                flush()
    flush()
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, tf = np.concatenate(keys), np.concatenate(tfs)
    if (key[1:] <= key[:-1]).any():  # the pieces of a long text share features
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, tf = key[first], np.add.reduceat(tf, first)
    return key >> bits, key & ((1 << bits) - 1), tf


def text_vectors(texts: Sequence[str], idf: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) with vectors of length 1; features without idf are left out."""
    row, col, tf = term_counts(texts, bits)
    value = (1.0 + np.log(tf)) * idf[col]
    some = value > 0
    row, col, value = row[some], col[some], value[some]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, col, value / norm[row]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << self.bits, len(self.languages)))
        out[self.features] = self.weights
        return out

    def probabilities(self, texts: Sequence[str], weights: np.ndarray) -> np.ndarray:
        """One row per text; ``weights`` is the dense form."""
        row, col, value = text_vectors(texts, self.idf, self.bits)
        z = np.tile(self.bias, (len(texts), 1))
        for c in range(len(self.languages)):
            z[:, c] += np.bincount(row, weights=value * weights[col, c], minlength=len(texts))
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(
    starts: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, classes: int, features: int,
    epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias): one text at a time, ``starts`` delimits the texts' features.

    ``z`` gathers gradients less the pull of past steps, ``n`` squared gradients. A weight is 0
    while ``|z| <= l1``; the bias is not penalised.
    """
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        pull = np.full((len(zs), 1), l1)
        ridge = np.full((len(zs), 1), l2)
        pull[-1], ridge[-1] = 0.0, 0.0
        w = -(zs - np.sign(zs) * pull) / ((beta + np.sqrt(ns)) / alpha + ridge)
        return np.where(np.abs(zs) <= pull, 0.0, w)

    for _ in range(epochs):
        for i in range(len(y)):
            at = np.r_[cols[starts[i] : starts[i + 1]], features]  # the bias comes last
            x = np.r_[values[starts[i] : starts[i + 1]], 1.0]
            zs, ns = z[at], n[at]
            w = solved(zs, ns)
            p = softmax((x @ w)[None, :])[0]
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    w = solved(z, n)
    return w[:-1], w[-1]


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the least mean log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, golden = -np.log(20.0), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(training: DataFrame, bits: int) -> np.ndarray:
    """How many texts have each feature, over all rows; counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                df += np.bincount(term_counts(texts, bits)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["feature", "n"])

    rows = training.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << bits, dtype=np.int64)  # one number per feature
    df[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return df


def _slices(column: pa.Array, size: int = 512) -> Iterator[list[str]]:
    for at in range(0, len(column), size):
        yield [t or "" for t in column.slice(at, size).to_pylist()]


def _sample(training: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """(lang, text): at most ``sample // languages`` distinct texts a language, drawn in hash order.

    A hash threshold leaves about twice as many candidates; only those are ranked.
    """
    each = max(1, sample // max(len(counts), 1))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (2.0 * each + 50.0) / n)))])
    drawn = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30)
    candidates = training.where(drawn).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "text")
    return candidates.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each)


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES, bits: int = BITS
) -> LanguageModel | None:
    """Learn from the documents that are not held out and have a language and a letter; None without any."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    training = known.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r["lang"]: r["n"] for r in sorted(rows, key=lambda r: r["lang"])}
    if not counts:
        return None
    names = list(counts)
    total = float(sum(counts.values()))
    frequency = _document_frequencies(training, bits)
    idf = np.where(frequency > 0, np.log((1.0 + total) / (1.0 + frequency)) + 1.0, 0.0).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, col, value = text_vectors([t or "" for t in part.column(2).to_pylist()], shared.value, bits)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (col.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["h", "lang", "cols", "vals"])

    drawn = _sample(training, counts, sample).select("h", "lang", "text").mapInArrow(vectors, "h long, lang string, cols array<int>, vals array<float>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one task, which holds the vectors of at most ``sample`` texts
        found = pa.Table.from_batches(list(batches)).combine_chunks()
        order = np.lexsort((found["lang"].to_numpy(zero_copy_only=False).astype(str), found["h"].to_numpy()))
        found = found.take(pa.array(order)).combine_chunks()
        cols, vals = (found[c].combine_chunks().flatten().to_numpy() for c in ("cols", "vals"))
        sizes = found["cols"].combine_chunks().value_lengths().to_numpy()
        y = np.array([names.index(x) for x in found["lang"].to_pylist()])
        check = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1

        def some(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            inside = np.repeat(mask, sizes)
            return np.r_[0, np.cumsum(sizes[mask])], cols[inside].astype(np.int64), vals[inside].astype(np.float64)

        w, b = ftrl(*some(~check), y[~check], len(names), 1 << bits)
        starts, at, x = some(check)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        z = np.tile(b, (len(starts) - 1, 1))
        for c in range(len(names)):
            z[:, c] += np.bincount(row, weights=x * w[at, c], minlength=len(z))
        used = np.flatnonzero((w != 0).any(axis=1))
        columns = [used.astype("<i8"), w[used].astype("<f8"), b.astype("<f8"), np.array([fitted_temperature(z, y[check])], "<f8")]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["used", "w", "b", "t"])

    row = drawn.repartition(1).mapInArrow(train, "used binary, w binary, b binary, t binary").first()
    used, w, b, t = (np.frombuffer(bytes(x), dtype=k) for x, k in zip(row, ("<i8", "<f8", "<f8", "<f8")))
    return LanguageModel(names, idf, used, w.reshape(len(used), len(names)), b, float(t[0]), bits)


def predict_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score): one row per row of ``docs``, from its text alone.

    ``score`` is the probability of the predicted language; of equally likely ones the first in
    code point order is predicted. NULL texts, texts without a letter and all texts without a model
    are ``und`` with score 0. Repeated rows stay, a NULL id is kept and counts as an empty text in
    the fold, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.dense() if model else None
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for texts in _slices(batch.column(1)):
                lettered = np.array([has_letter(t) for t in texts], dtype=bool)
                if model is None:
                    names += [UNKNOWN] * len(texts)
                    scores.append(np.zeros(len(texts)))
                    continue
                p = model.probabilities(texts, weights)
                best = p.argmax(axis=1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores.append(np.where(lettered, p.max(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.empty(0)]))], schema.names)

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
