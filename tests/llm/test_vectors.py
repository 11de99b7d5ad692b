import numpy as np

from panelforge.llm.hnsw import Hnsw
from panelforge.llm.vectors import _Shard, near_vectors, unit


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    place = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and unit(x[None])[0] @ unit(y[None])[0] >= threshold:
                links[place[a]].add(place[b]), links[place[b]].add(place[a])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n), todo.append(n)
        out.append((i, len(links[k]), min(rows[s][0] for s in seen)))
    return sorted(out)


def clustered(n, dims, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    return centres[rng.integers(0, len(centres), n)] + 0.1 * rng.standard_normal((n, dims))


def test_graph_finds_what_brute_force_finds():
    x = unit(np.random.default_rng(1).standard_normal((1500, 32))).astype(np.float32)
    ids, sims = Hnsw(x).search(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    found = np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)])
    assert found > 0.9
    assert (np.diff(sims, axis=1) <= 0).all()


def test_components_and_counts_match_brute_force(spark):
    x = clustered(400, 16)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, [2 * v for v in rows[3][1]])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=3, beam=4).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 0.0, 0.0], [3.0, 0.1], [1e30, 0.0]]
    rows = [(i, v, "x", "y") for i, v in enumerate(vectors)] + [(0, [1.0, 0.0], "x", "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id string, cid string")
    got = near_vectors(df, shards=2).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute([r[:2] for r in rows])
    assert near_vectors(df.where("false")).count() == 0
    assert near_vectors(df.where("vec_id = 3")).first()["n_links"] == 0


def shard_links(shard, x):
    """(query, node) positions that the shard reports for its own vectors."""
    out = shard.links(np.arange(len(x)), x)
    pairs = [out] if isinstance(out, tuple) else list(out)
    return {(int(r), int(c)) for rows, nodes in pairs for r, c in zip(rows, nodes)}


def true_links(x, threshold=0.95):
    return {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= threshold) if a != b}


def test_links_that_no_beam_reaches_are_found():
    x = unit(clustered(400, 16))
    shard = _Shard(np.arange(400), np.ones(400, dtype=int), x, 0.95, 4, 0.99)
    shard.graph.layers[0][:, 2:] = -1  # nearly all nodes are cut off
    assert shard_links(shard, x) == true_links(x)


def test_a_hot_group_does_not_cover_for_a_missed_link():
    rng = np.random.default_rng(2)
    hot = np.tile(rng.standard_normal(16), (240, 1)) + 0.01 * rng.standard_normal((240, 16))
    rest = rng.standard_normal((160, 16))
    rest[1] = rest[0] + 0.01 * rng.standard_normal(16)
    x = unit(np.concatenate([rest, hot]))
    shard = _Shard(np.arange(400), np.ones(400, dtype=int), x, 0.95, 4, 0.99)
    lost = int(np.nonzero(shard.graph.order == 1)[0][0])
    assert lost >= shard.graph.sizes[-1]
    shard.graph.layers[0][shard.graph.layers[0] == lost] = -1  # no way leads to node 1, and query 0 is audited
    assert shard_links(shard, x) == true_links(x)


def test_a_report_is_a_spanning_forest_with_counts():
    x = unit(clustered(300, 16))
    copies = np.arange(300) % 3 + 1
    got = _Shard(np.arange(300), copies, x, 0.95, 4, 0.99).report(np.arange(300), x).to_pydict()
    want = np.zeros(300, dtype=int)
    for a, b in true_links(x):
        want[a] += copies[b]
    assert (np.bincount(got["u"], weights=got["links"], minlength=300) == want).all()
    assert set(zip(got["u"], got["v"])) <= true_links(x)


def test_queries_after_a_passed_audit_come_from_the_graph():
    x = unit(clustered(2_000, 16))
    shard = _Shard(np.arange(2_000), np.ones(2_000, dtype=int), x, 0.95, 4, 0.99)
    want = true_links(x)
    found = set()
    for ids, audited in ((np.arange(300), True), (np.arange(300, 2_000), False)):
        for rows, nodes in shard.links(ids, x[ids], audited):
            found |= {(int(ids[r]), int(c)) for r, c in zip(rows, nodes)}
    assert found <= want and len(found) >= 0.99 * len(want)
    assert not shard.exact and shard.audited[0] > 0 and shard.audited[1] >= 0.99 * shard.audited[0]


def test_a_failed_audit_compares_all_later_queries():
    x = unit(clustered(600, 16))
    shard = _Shard(np.arange(600), np.ones(600, dtype=int), x, 0.95, 4, 0.99)
    shard.graph.search = lambda q, beam: (np.zeros((len(q), beam), dtype=np.int64), np.full((len(q), beam), -1.0, dtype=np.float32))  # finds nothing
    list(shard.links(np.arange(64), x[:64], True))
    assert shard.exact
    rest = {(int(r) + 64, int(c)) for rows, nodes in shard.links(np.arange(64, 600), x[64:], False) for r, c in zip(rows, nodes)}
    assert rest == {p for p in true_links(x) if p[0] >= 64}


def test_planted_groups_among_twenty_thousand_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 64))
    at = 0
    for size in [2] * 400 + [7] * 100 + [60] * 20 + [900]:  # near copies of the first vector of each group
        x[at : at + size] = x[at] + 0.08 * rng.standard_normal((size, 64))
        at += size
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = unit(x)
    links = np.zeros(len(x), dtype=int)
    least = np.arange(len(x))
    for s in range(0, len(x), 2_000):
        near = q[s : s + 2_000] @ q.T >= 0.95
        links[s : s + 2_000] = near.sum(axis=1) - 1
        least[s : s + 2_000] = near.argmax(axis=1)
    while (least[least] != least).any():
        least = least[least]
    got = near_vectors(df, shard_rows=2_500, shards=4, audits=500).toPandas().sort_values("vec_id")
    assert links.sum() > 800_000
    found = got["n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= (1 - 1e-5) * links.sum()
    assert (got["component_id"].to_numpy() == least).all()
