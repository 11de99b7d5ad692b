import math
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import ranking

from .cases import documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """Every document scored for every item, term by term."""
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in found:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def got(frame):
    return sorted([tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect()], key=repr)


def test_terms():
    text = "It's É-b_c9 \x00x\x7fÀ ÀB ǅ"
    assert [t.decode() for t in ranking.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("shard_rows", [5, 400, 10**6])
def test_equals_scoring_of_every_document(spark, shard_rows):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choice(words, n, p=np.arange(60, 0, -1) / 1830))
    docs = [(i, draw(int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)]  # copies: ties that reach beyond the k-th place
    items = [(i, draw(12)) for i in range(8)] + [(8, docs[0][1]), (9, "unknown Word"), (10, "w59 w59 w59")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.rank_documents(frame, asked, k=7, shard_rows=shard_rows)) == plain(docs, items, 7)


def test_blocks_of_items_change_nothing(spark):
    docs = [(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(50)]
    items = [(i, f"beta{i % 7} gamma{i % 3} alpha") for i in range(12)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.rank_documents(frame, asked, k=4, item_bytes=64)) == plain(docs, items, 4)


def test_odd_rows(spark):
    docs = documents(spark)
    items = [(1, "One TWO three"), (2, None), (3, ""), (3, "word"), (None, "lost words a b"), (1, "One TWO three"), (4, "élise Élise")]
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    plain_docs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(ranking.rank_documents(docs, asked)) == plain(plain_docs, items, 20)
    assert ranking.rank_documents(empty(docs), asked).count() == 0
    assert ranking.rank_documents(docs, empty(asked)).count() == 0


def test_reading_stops_before_the_lists_end(monkeypatch):
    # one document holds the rare terms, so the long list of the common one settles nothing
    n = 20_000
    term = np.r_[np.zeros(n, int), 1, 2]
    doc = np.r_[np.arange(n), 7, 7]
    impact = np.r_[np.linspace(1000, 1, n).astype(int), 10**6, 10**6]
    shard = ranking.Shard(term, doc, impact, n, 3)
    reads = []
    arange = np.arange
    monkeypatch.setattr(ranking.np, "arange", lambda *a: (reads.append(a), arange(*a))[1])
    found, score = shard.best(np.array([0, 1, 2]), np.array([1, 1, 1]), 1)
    monkeypatch.undo()
    assert list(found) == [7] and score[0] == 2 * 10**6 + impact[7]
    assert sum(e - s for s, e in (a for a in reads if len(a) == 2)) < n // 2
