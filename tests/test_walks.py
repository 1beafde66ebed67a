import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import contacts, graph, spectral, walks


def arrays(pairs):
    both = sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})
    return np.array([a for a, _ in both]), np.array([b for _, b in both])


STAR, PATH, K4 = [(0, i) for i in range(1, 5)], [(i, i + 1) for i in range(4)], [(i, j) for i in range(4) for j in range(i)]


@pytest.mark.parametrize(
    "pairs,seed,ledger,halt",
    [
        (PATH, 0, [(0, 0, 0, 1, 2, 1), (1, 1, 0, 1, 1, 1)], "best already flipped"),
        (STAR, 0, [(0, 0, 0, 1, 4, 4)], "no positive gradient"),
        (STAR, 1, [(0, 1, 0, 1, 4, 1), (1, 0, 0, 1, 2, 4)], "best already flipped"),
        (K4, 0, [(0, 0, 0, 1, 9, 3), (1, 1, 0, 1, 3, 3)], "best already flipped"),
    ],
)
def test_small_ledgers(pairs, seed, ledger, halt):
    assert walks.ratchet(*arrays(pairs), seed) == (ledger, halt)


def test_walk_is_a_self_avoiding_path():
    for seed in range(100):
        r = random.Random(seed)
        n = r.randint(2, 15)
        pairs = {(a, b) for a in range(n) for b in range(a) if r.random() < 0.3}
        src, dst = arrays(pairs)
        ledger, _ = walks.ratchet(src, dst, 0)
        nodes = [row[1] for row in ledger]
        assert len(set(nodes)) == len(nodes) and all(row[4] > 0 for row in ledger)
        assert all((min(a, b), max(a, b)) in {(min(p), max(p)) for p in pairs} for a, b in zip(nodes, nodes[1:]))


def test_walk_as_a_table(spark):
    e = graph.symmetrize(spark.createDataFrame(PATH, "src long, dst long"))
    got = walks.ratchet_walk(e, spark.createDataFrame([(0,)], "seed long"))
    assert sorted((r.f, r.n, r.s, r.t, r.g, r.a) for r in got.collect()) == [(0, 0, 0, 1, 2.0, 1), (1, 1, 0, 1, 1.0, 1)]
    assert {r.n: r.f for r in walks.first_flip(got).collect()} == {0: 0, 1: 1}


def test_wave_needs_frames_and_comes_back(spark):
    e = graph.symmetrize(spark.createDataFrame(PATH, "src long, dst long"))
    got = {}
    for r in walks.excitable_wave(e, 0, 6).collect():
        got.setdefault(r.frame, set()).add(r.id)
    assert got == {0: {0}, 1: {1}, 2: {0, 2}, 3: {1, 3}, 4: {0, 2, 4}, 5: {1, 3}, 6: {0, 2, 4}}
    assert walks.excitable_wave(e, 99, 3).count() == 1
    with pytest.raises(ValueError):
        walks.excitable_wave(e, 0, -1)


def test_snap_ranks(spark):
    v = spark.createDataFrame([("s", 1, 0.5), ("s", 2, -1.0), ("s", 3, 0.5), ("s", 4, 0.9), ("t", 1, -1.0)], "k string, id long, dv double")
    got = {(r.k, r.id): (r.snap_rank, r.pms) for r in walks.snap_ranks(v, ["k"]).collect()}
    assert got == {("s", 4): (1, 3), ("s", 1): (2, 2), ("s", 3): (3, 1), ("s", 2): (-1, 0), ("t", 1): (-1, 0)}


def test_meeting_walks(spark):
    a = spark.createDataFrame([(1, 3), (2, 5), (3, -1)], "id long, frame int")
    b = spark.createDataFrame([(1, 4), (3, 2), (9, 0)], "id long, frame int")
    assert {r.id: r.arrival for r in walks.meet(a, b).collect()} == {1: 4, 2: -1, 3: -1, 9: -1}


def test_fiedler_vector_of_a_path():
    src, dst = arrays(PATH)
    v, value, parts = spectral.fiedler_vector(src, dst, np.arange(5))
    want = np.cos(np.pi * (np.arange(5) + 0.5) / 5)
    assert parts == 1 and abs(value - (2 - 2 * np.cos(np.pi / 5))) < 1e-9
    assert np.allclose(v / v[0], want / want[0])


def test_fiedler_failures_stay_in_their_system(spark, monkeypatch):
    e = graph.symmetrize(spark.createDataFrame(PATH, "src long, dst long")).selectExpr("'a' as k", "src", "dst")
    nodes = spark.range(5).selectExpr("'a' as k", "id").union(spark.range(spectral.MOST_NODES + 1).selectExpr("'b' as k", "id"))
    got = spectral.fiedler(e, nodes, "k").collect()
    assert [r.status for r in got if r.k == "b"] == ["PIPELINE_FAILURE"] and len([r for r in got if r.k == "a" and r.status == "OK"]) == 5


def test_ledger_stream(spark, tmp_path):
    from tessera.streaming import first_flips

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"f":3,"n":1,"s":0,"t":1,"g":2.0,"a":1,"ns":5}\n{"f":2,"n":1,"s":0,"t":1,"g":2.0,"a":1,"ns":5}\n{"f":7,"n":2,"s":0,"t":1,"g":2.0,"a":1,"ns":5}\n')
    q = first_flips(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("flips").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n: r.f for r in spark.table("flips").collect()} == {1: 2, 2: 7}


def _summed_anew(edges, seed):
    """The walk with every gain added up over all neighbours at each step."""
    near = {}
    for a, b in sorted(edges):
        near.setdefault(a, []).append(b)
    degree, turned, queue, out = {n: len(x) for n, x in near.items()}, set(), [seed], []

    def gain(n):
        on = sum(degree.get(j, 0) for j in near.get(n, ()) if j in turned)
        off = sum(degree.get(j, 0) for j in near.get(n, ()) if j not in turned)
        return on if n in turned else off - on

    while True:
        ranked = [(gain(n), degree.get(n, 0), -i, n) for i, n in enumerate(queue)]
        best = max((x for x in ranked if x[0] > 0), default=None)
        if best is None or best[3] in turned:
            return out
        turned.add(best[3])
        queue = [j for j in near.get(best[3], ()) if gain(j) != 0]
        out.append((best[3], float(best[0]), len(queue)))


@pytest.mark.parametrize("seed", range(12))
def test_kept_gains_equal_those_summed_anew(seed):
    r = random.Random(seed)
    n = r.randint(2, 25)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 60))]  # one-way edges, loops and repeats too
    if seed % 2:
        edges = sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges})
    src, dst = (np.array(x) for x in zip(*edges))
    got, _ = walks.ratchet(src, dst, edges[0][0])
    assert [(x[1], x[4], x[5]) for x in got] == _summed_anew(edges, edges[0][0])


def test_a_hub_of_many_leaves_is_walked_at_once():
    """Steps between hubs touch the leaves once each; summed anew they would be added up for every leaf of every queue."""
    import time

    leaves = 100_000
    a = np.r_[np.zeros(leaves, np.int64), np.arange(leaves) + 10]
    b = np.r_[np.arange(leaves) + 10, np.zeros(leaves, np.int64)]
    chain = np.array([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)])
    start = time.time()
    ledger, _ = walks.ratchet(np.r_[a, chain[:, 0]], np.r_[b, chain[:, 1]], 3)
    assert ledger[0][1] == 3 and 0 in {x[1] for x in ledger} and time.time() - start < 20


def test_a_ratchet_walk_over_points_equals_that_over_edges_and_makes_none(spark, monkeypatch):
    from tessera.operators import graph

    r = random.Random(5)
    p = spark.createDataFrame([(i % 3, i, *[r.gauss(0, 1) for _ in "xyz"]) for i in range(240)] + [(3, 300, 0.0, 0.0, 0.0), (4, 400, 1.0, 1.0, 1.0), (4, 401, 1.0, 1.0, 1.0)], "entity int, id long, x double, y double, z double")
    e = graph.radius_edges(p, 0.8, ["entity"]).select("entity", "src", "dst").persist()
    want = walks.ratchet_walk(e, e.groupBy("entity").agg(F.min("src").alias("seed")), ["entity"])
    rows = lambda d: sorted(tuple(x) for x in d.select("entity", "f", "n", "g", "a", "halt").collect())
    want = rows(want)
    monkeypatch.setattr(graph, "radius_edges", None)
    monkeypatch.setattr(contacts, "OWN_ROWS", 7)
    assert rows(walks.ratchet_walk_near(p, 0.8, ["entity"])) == want and len(want) > 5
