import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm.simhash import _chain, drop_near_copies, fingerprint_hex, near_groups, near_links, text_fingerprint

from .cases import documents, empty


def brute_components(fps, distance=3):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def brute_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_matches_bit_by_bit():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rnd.choice("Ab Éc dEf x".split()) for _ in range(n))
        assert text_fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_links_have_the_components_of_all_near_pairs(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(rnd.randrange(6)):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5)))
            fps.add(base)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)}
    fps = {signed(f) for f in fps}
    edges = near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 3 for r in edges)
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in edges:
        x, y = find(r["u"]), find(r["v"])
        parent[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == brute_components(fps)
    # a dense group is not expanded into its pairs
    assert len(edges) < 20 * len(fps)


def test_chain_keeps_every_near_pair(spark):
    rnd = random.Random(2)
    diffs = [signed(sum(1 << b for b in rnd.sample(range(64), k))) for k in (0, 1, 2, 3) for _ in range(200)]
    df = spark.createDataFrame([(d,) for d in diffs], "d long")
    viable = _chain(F.col("d"), 4, 3)
    assert df.where(viable[0] | viable[1] | viable[2] | viable[3]).count() == len(diffs)


def test_groups_match_brute_force_on_odd_rows(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = {signed(brute_fingerprint(r["text"])) for r in rows}
    comp = brute_components(fps)
    least = {}
    for r in rows:
        c = comp[signed(brute_fingerprint(r["text"]))]
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((repr(r["doc_id"]), f"{brute_fingerprint(r['text']):016x}", repr(least.get(comp[signed(brute_fingerprint(r['text']))]))) for r in rows)
    got = near_groups(docs).select("doc_id", fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted((repr(r["doc_id"]), r["f"], repr(r["component_id"])) for r in got) == want
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert ids == {None} | {v for v in least.values()}
    assert near_groups(empty(docs)).count() == 0


def test_key_needs_a_short_distance(spark):
    with pytest.raises(ValueError):
        near_links(spark.createDataFrame([(1,)], "fp long"), distance=4)


def test_members_of_one_group_never_meet(spark):
    """A dense group and a far one that share a key: only pairs between the groups are compared."""
    from panelforge.llm import simhash

    # neighbours in sorted order link each of the two by themselves
    centre, other = 0xABCDEF << 40, 0xABCDEF << 40 | 0xFF_FFFF_0000
    dense = [signed(centre), *[signed(centre ^ 1 << b) for b in range(64)]]
    far = [signed(other), *[signed(other ^ 1 << b) for b in range(16)]]
    fps = spark.createDataFrame([(f,) for f in dense + far], "fp long")
    edges = near_links(fps).collect()
    assert len(edges) <= simhash.BITS // simhash.SORT_BITS * len(dense + far)
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 3 for r in edges)
    ids = {f: c for f, c in brute_components(set(dense + far)).items()}
    assert len(set(ids.values())) == 2
    assert all(ids[r["u"]] == ids[r["v"]] for r in edges)
