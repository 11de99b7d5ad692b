import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import lm

from .cases import documents, empty


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def learns(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = [[f"{p}{i}" for i in range(30)] for p in ("uno", "zwei")]  # two languages
    rows = [(i, " ".join(rng.choice(words[i % 2], 40))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_score_and_counts(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if learns(r["doc_id"]):
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(r["doc_id"]), not learns(r["doc_id"]), len(tokens(r["text"])), sum(counts[t] > 0 for t in tokens(r["text"])), n) for r in rows)
    # few frequent tokens, so that most counts come from the join
    got = lm.score_texts(docs, words=4, frequent=6).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = sorted(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r["text"])) for r in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base)
    assert lm.score_texts(empty(docs)).count() == 0


def test_model_beats_the_base_on_held_out_texts(corpus):
    got = [r for r in lm.score_texts(corpus, words=20).collect() if r["held_out"]]
    assert len(got) > 20
    assert all(r["score"] > r["base_score"] for r in got)


def test_probabilities_sum_to_one(spark, corpus):
    counts = lm.token_counts(corpus.select("text"))
    v, model = lm.fit(counts, corpus.select("text"), words=10, frequent=15)
    table = model.log10_table()
    assert np.allclose((10**table).sum(axis=1), 1, atol=1e-4)
    # inside a class: its tokens and one unseen token
    inside = np.zeros(v.size)
    for r in counts.collect():
        cls = v.ids([bytes(r["token"])])[0]
        if cls >= v.own:
            inside[cls] += 10 ** v.log_inside([cls], r["c"])[0]
    used = np.nonzero(inside)[0]
    for c in used:
        assert math.isclose(inside[c] + 10 ** v.log_inside([c], 0)[0], 1, rel_tol=1e-9)


def test_score_is_the_sum_over_tokens(spark, corpus):
    training = corpus.where(~lm.held_out(corpus["doc_id"])).select("text")
    counts = lm.token_counts(training)
    v, model = lm.fit(counts, training, words=10, frequent=15)
    table, c = model.log10_table(), {bytes(r["token"]): r["c"] for r in counts.collect()}
    want = {}
    for r in corpus.collect():
        cls = v.ids(tokens(r["text"]))
        inside = [v.log_inside([k], c.get(t, 0))[0] for k, t in zip(cls, tokens(r["text"]))]
        want[r["doc_id"]] = table[np.r_[0, cls[:-1]], cls].sum() + sum(inside)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(corpus, words=10, frequent=15).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-4) for k in want)
