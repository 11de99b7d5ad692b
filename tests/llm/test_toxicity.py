import math

import numpy as np
import pytest

from panelforge.llm.toxicity import Chain, Linear, drop_toxic, fit_chain, fit_chain_arrays, score_chain, text_features

from .cases import documents, empty


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, int(rng.integers(5, 200))))
        rude, vile = i % 6 == 0, i % 12 == 0
        if rude:
            words += ["grubling", "grublings"][: 1 + vile]
        docs.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(vile), int(rude)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, vile int, rude int")


def test_features_are_words_and_prefixes():
    assert text_features("Idiots, (a) IDIOTIC") == {"idiots", "a", "idiotic", "idio~", "idiot~", "idiots~", "idioti~"}


def test_chain_separates_and_generalises_to_inflected_forms(spark, labelled):
    docs, labels = labelled
    known = labels.where("doc_id < 400")
    chain = fit_chain(docs, known, ["vile", "rude"], per_class=300)
    scored = {r["doc_id"]: r for r in score_chain(docs, chain).collect()}
    truth = {r["doc_id"]: r["rude"] for r in labels.collect()}
    assert all(scored[i]["rejected"] == bool(truth[i]) for i in truth)
    new = spark.createDataFrame([(1, "a grublingest thing"), (2, "word1 word2")], "doc_id long, text string")
    assert [r["rejected"] for r in score_chain(new, chain).orderBy("doc_id").collect()] == [True, False]
    left = drop_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == sum(1 - t for t in truth.values())


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.random((n, 5)) < 0.3
    rows, cols = np.nonzero(x)
    y = np.c_[x[:, 0], x[:, 0] & x[:, 1]].astype(float)
    chain, held = fit_chain_arrays(rows, cols, y, np.ones(n), ["a", "b"], [f"f{i}" for i in range(5)])
    assert len(chain.models[0].weights) == 5 and len(chain.models[1].weights) == 6
    assert ((held[:, 0] > 0.5) == (y[:, 0] > 0.5)).mean() > 0.99
    assert chain.models[1].weights[5] != 0
    p = chain.probabilities(rows, cols, n)
    assert ((p[:, 1] > 0.5) == (y[:, 1] > 0.5)).mean() > 0.97


def test_odd_rows_and_missing_labels(spark, labelled):
    docs = documents(spark)
    none = labelled[1].where("false")
    chain = fit_chain(docs, none, ["vile", "rude"])
    assert chain.features == []
    rows = score_chain(docs, chain).collect()
    assert len(rows) == docs.count() and not any(r["rejected"] for r in rows)
    assert drop_toxic(docs, chain).columns == docs.columns
    assert drop_toxic(docs, chain).count() == docs.count()
    assert score_chain(empty(docs), chain).count() == 0
    fitted = fit_chain(docs, spark.createDataFrame([(0, 0, 0), (1, 0, None), (5, 1, 1)], "doc_id long, vile int, rude int"), ["vile", "rude"])
    assert score_chain(docs, fitted).count() == docs.count()
    assert isinstance(fitted, Chain)


def test_scores_equal_a_plain_loop_along_the_chain(spark):
    rng = np.random.default_rng(8)
    features = ["bad", "badl~", "worse", "fine", "été"]
    chain = Chain(["a", "b", "c"], features, [Linear(rng.normal(size=5 + j), float(rng.normal())) for j in range(3)])
    texts = ["Bad, bad!", "badly worse", "", None, "fine day " * 5_000, "ÉTÉ (badlands)", "nothing"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "bad", 1.0)], "doc_id long, text string, p_a double")
    got = {(r["doc_id"], r["p_a"], r["p_b"], r["p_c"], r["rejected"]) for r in score_chain(df, chain).collect()}

    def plain(text):
        words = {w.strip(".,;:!?\"'()[]{}<>#$%&*|-_/\\") for w in (text or "").lower().split()} - {""}
        present = {f for f in features if f in words or f.endswith("~") and any(len(w) >= len(f) - 1 and w.startswith(f[:-1]) for w in words)}
        out = []
        for m in chain.models:
            z = m.bias + sum(m.weights[k] for k, f in enumerate(features) if f in present) + sum(w * p for w, p in zip(m.weights[5:], out))
            out.append(1 / (1 + math.exp(-z)))
        return out

    want = {(i, *plain(t)) for i, t in [*enumerate(texts), (None, "bad")]}
    rows = {(k[0], *(round(v, 12) for v in k[1:4])) for k in got}
    assert rows == {(k[0], *(round(v, 12) for v in k[1:])) for k in want}
    assert all(k[4] == (k[3] >= 0.5) for k in got)
