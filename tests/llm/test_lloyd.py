import hashlib
import math

import numpy as np

from panelforge.llm import lloyd


def plain(rows, k, rounds, dims, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [list(q) for _, q in named[:k]]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        labels = [j for _, j in assign()]
        for j in range(len(centroids)):
            own = [q for (_, q), x in zip(kept, labels) if x == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = assign()
    inertia = {j: sum(d for d, x in last if x == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last)), key=repr)


def got(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")


def test_equals_plain_rounds_in_any_tiling(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(300, 10)))]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a hot vector
    want = plain(rows, 6, 3, 10)
    for width, size, parts in ((10, 1000, 1), (3, 7, 5), (1, 64, 3)):
        df = frame(spark, rows).repartition(parts)
        assert got(lloyd.centroid_clusters(df, k=6, dims=10, width=width, rows=size)) == want


def test_odd_vectors(spark):
    v = [0.5, -0.25, 0.015625]
    rows = [(1, v), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0])]
    rows += [(None, [0.1, 0.1, 0.1]), (8, v), (8, v), (9, [-0.001, 0.0, 1000.0]), (10, [0.0, 0.0, 0.0])]
    for k in (1, 3, 16):
        assert got(lloyd.centroid_clusters(frame(spark, rows), k=k, dims=3)) == plain(rows, k, 3, 3)
    assert lloyd.centroid_clusters(frame(spark, rows).where("false"), dims=3).count() == 0
    assert lloyd.centroid_clusters(frame(spark, rows[1:7]), dims=3).count() == 0
    assert lloyd.centroid_clusters(frame(spark, rows[7:8]), dims=3).count() == 0  # nothing to start from
