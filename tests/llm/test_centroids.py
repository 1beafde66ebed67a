"""Centroid clustering against plain Python with whole numbers."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tessera.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def vectors(n=120, size=4, seed=3):
    rng = random.Random(seed)
    base = [[rng.uniform(-2, 2) for _ in range(size)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(base)]) for i in range(n)]
    rows += [(n + i, list(base[0])) for i in range(n // 2)]  # one vector that holds a third of the rows
    rows += [(5, rows[5][1]), (None, base[1]), (7, [0.0] * size), (n * 2, [-0.0] * size), (n * 2 + 1, [-1 / 64, 1 / 64, -1 / 128, 1 / 128])]
    bad = [(900, None), (901, []), (902, [1.0] * (size - 1)), (903, [1.0] * (size + 1)), (904, [math.nan] + [0.0] * (size - 1)), (905, [math.inf] * size), (906, [None] + [1.0] * (size - 1)), (907, [-math.inf] + [1.0] * (size - 1))]
    return rows, bad


def plain(rows, k, rounds=3, seed=1):
    pts = [(v, [math.floor(64 * x) for x in e]) for v, e in rows]
    order = sorted(pts, key=lambda p: (hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    cent = [q for _, q in order[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min((far(q, c), i) for i, c in enumerate(cent))
    for _ in range(rounds):
        own = [[] for _ in cent]
        for _, q in pts:
            own[near(q)[1]].append(q)
        cent = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, cent)]
    got = [(v, near(q)[1], near(q)[0]) for v, q in pts]
    inertia = Counter()
    for _, c, d in got:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    times = Counter(tuple(q) for _, q in pts)
    return Counter((v, c, d, inertia[c], sum(inertia.values()), name[c], times[tuple(q)]) for (v, c, d), (_, q) in zip(got, pts))


@pytest.mark.parametrize("k", [1, 6, 16])
def test_equals_plain_rounds(spark, k):
    rows, bad = vectors()
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows + bad], SCHEMA).repartition(5)
    got = centroids.cluster(df, k=k, size=4).collect()
    assert Counter(tuple(r) for r in got) == plain(rows, k)


def test_heavy_vectors_are_sent_and_the_rest_joined(spark, monkeypatch):
    rows, _ = vectors()
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], SCHEMA).repartition(3)
    for heavy in (1, 10, 100_000):  # none is heavy, some are, all are
        monkeypatch.setattr(centroids, "HEAVY", heavy)
        assert Counter(tuple(r) for r in centroids.cluster(df, k=5, size=4).collect()) == plain(rows, 5)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], SCHEMA)
    assert Counter(tuple(r) for r in centroids.cluster(df, k=4, size=4).collect()) == plain(rows, 4)
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster(spark.createDataFrame([(1, [3e6, 0.0, 0.0, 0.0], 1, "x")], SCHEMA), size=4).collect()


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], SCHEMA)
    assert Counter(tuple(r) for r in centroids.cluster(df, size=2).collect()) == plain(rows, 16)
    none = centroids.cluster(df.where("vec_id > 9"), size=2)
    assert none.collect() == [] and none.dtypes == centroids.cluster(df, size=2).dtypes


def test_ties_go_to_the_smaller_cluster():
    import numpy as np

    best, d = centroids.nearest(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert best.tolist() == [0, 0] and d.tolist() == [4, 4]
