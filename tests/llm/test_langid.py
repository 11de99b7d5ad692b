import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import langid
from panelforge.llm.common import table

from .cases import documents, empty


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def squeezed(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def plain_counts(text):
    """Features of a text gram by gram, with the same hash on Python integers."""
    words = squeezed(text)
    out = Counter()
    if not words:
        return out
    padded = " " + " ".join(words) + " "
    mask = (1 << 64) - 1
    for size in langid.SIZES:
        for i in range(len(padded) - size + 1):
            h = size
            for c in padded[i : i + size]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            out[((h * 0xBF58476D1CE4E5B9) & mask) >> (64 - langid.BITS)] += 1
    return out


TEXTS = ["The cat; the dog!", "", "a", "  ..1 ", "Ünïcode ßtraße 漢字仮名", "x" * 50, "no-no no"]


def test_term_counts_equal_plain_counts(monkeypatch):
    want = [(i, f, n) for i, t in enumerate(TEXTS) for f, n in sorted(plain_counts(t).items())]
    assert list(zip(*(x.tolist() for x in langid.term_counts(TEXTS)))) == want
    monkeypatch.setattr(langid, "PIECE", 5)  # pieces and sorts of a few characters
    assert list(zip(*(x.tolist() for x in langid.term_counts(TEXTS)))) == want


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    words = {"aa": ["kala", "muna", "tiri", "loko"], "bb": ["zvex", "quorn", "plith", "wump"], "cc": ["été", "ñandú", "über", "ça"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(rng.choice(words[lang], 12)), lang if i % 20 else None))
    rows += [(1000 + i, rows[0][1], "aa") for i in range(50)]  # copies
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_predictions_equal_a_plain_loop(spark, corpus):
    model = langid.fit_language_model(corpus, sample=120)
    rows = corpus.collect()
    training = [r for r in rows if not held(r["doc_id"]) and r["lang"] is not None]
    df = Counter(f for r in training for f in plain_counts(r["text"]))
    idf = {f: math.log((1 + len(training)) / (1 + n)) + 1 for f, n in df.items()}
    weight = model.dense()
    got = {r["doc_id"]: r for r in langid.predict_languages(corpus, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = {f: (1 + math.log(n)) * idf[f] for f, n in plain_counts(r["text"]).items() if f in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(model.bias[c] + sum(v / norm * weight[f, c] for f, v in x.items())) / model.temperature for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(3), key=lambda c: (p[c], -c))
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best] == ("aa", "bb", "cc")[r["doc_id"] % 3 if r["doc_id"] < 1000 else 0]
        assert math.isclose(got[r["doc_id"]]["score"], p[best] / sum(p), rel_tol=1e-4)
        assert got[r["doc_id"]]["held_out"] == held(r["doc_id"])


def test_learns_nothing_from_held_out_or_source(spark, corpus):
    from pyspark.sql import functions as F

    changed = corpus.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.fit_language_model(corpus, sample=120), langid.fit_language_model(changed, sample=120)
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_ftrl_steps_and_sparsity():
    # one text, one feature, two classes: the closed form of the first step
    w, b = langid.ftrl(np.array([0, 1]), np.array([0]), np.array([1.0]), np.array([0]), 2, 2, epochs=1, alpha=0.5, beta=1.0, l1=0.1, l2=0.3)
    z, n = -0.5, 0.25
    assert np.isclose(w[0, 0], -(z + 0.1) / ((1 + math.sqrt(n)) / 0.5 + 0.3)) and np.isclose(w[0, 1], -w[0, 0])
    assert np.isclose(b[0], -z / ((1 + math.sqrt(n)) / 0.5)) and (w[1] == 0).all()
    w, _ = langid.ftrl(np.array([0, 1]), np.array([0]), np.array([1.0]), np.array([0]), 2, 2, epochs=1, l1=0.6)
    assert (w == 0).all()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 3)) * 6
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z / 3.0)])
    t = langid.fitted_temperature(z, y)

    def loss(t):
        return -np.log(langid.softmax(z / t)[np.arange(400), y]).mean()

    assert 2 < t < 4.5 and loss(t) <= min(loss(t * 1.02), loss(t / 1.02))
    assert langid.fitted_temperature(z[:0], y[:0]) == 1.0


def test_held_out_accuracy(spark, small_dir):
    docs = table(spark, small_dir.replace("0.001", "0.01"), "documents")
    rows = langid.predict_languages(docs, langid.fit_language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    docs = documents(spark)
    out = langid.predict_languages(docs, langid.fit_language_model(docs)).collect()
    assert len(out) == docs.count()
    assert {r["lang_pred"] for r in out} == {"en", "und"}
    assert all(r["score"] == (0.0 if r["lang_pred"] == "und" else 1.0) for r in out)
    assert langid.fit_language_model(empty(docs)) is None
    none = langid.predict_languages(docs, None).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.predict_languages(empty(docs), None).count() == 0
