import random

import pytest

from tessera.operators import graph, traverse
from tessera.operators.components import connected_components


def edges(spark, pairs):
    return graph.symmetrize(spark.createDataFrame(pairs, "src long, dst long"))


def frames(df):
    return {r.id: r.frame for r in df.collect()}


PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_path_graph(spark, plan):
    e = edges(spark, PATH)
    got = traverse.bfs(e, 0, plan=plan)
    assert frames(got) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert traverse.reach(got).first().asDict() == {"reached": 5, "max_frame": 4, "n_frames": 5}


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_two_components_loops_and_repeats(spark, plan):
    e = edges(spark, [(1, 2), (2, 1), (1, 1), (2, 3), (8, 9)])
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, 20)], "id long")
    got = traverse.with_unreached(traverse.bfs(e, 1, nodes=nodes, plan=plan), nodes)
    assert frames(got) == {1: 0, 2: 1, 3: 2, 8: -1, 9: -1, 20: -1}


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_isolated_seed_and_empty_graph(spark, plan):
    e = edges(spark, [])
    assert frames(traverse.bfs(e, 7, plan=plan)) == {7: 0}


def test_invalid_seeds(spark):
    e = edges(spark, PATH)
    nodes = spark.range(5)
    with pytest.raises(ValueError):
        traverse.bfs(e, 17, nodes=nodes)
    with pytest.raises(ValueError):
        traverse.bfs_multi(e, [])


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_directed_graph(spark, plan):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    assert frames(traverse.bfs(e, 0, plan=plan, symmetric=False)) == {0: 0, 1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_directed_rings_end(spark, plan):
    e = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src long, dst long")
    assert frames(traverse.bfs(e, 0, plan=plan)) == frames(traverse.bfs(e, 0, plan=plan, most=12)) == {i: i for i in range(5)}


@pytest.mark.parametrize("seed", range(3))
def test_both_plans_agree_on_directed_graphs(spark, seed):
    r = random.Random(seed)
    e = spark.createDataFrame([(r.randrange(30), r.randrange(30)) for _ in range(45)], "src long, dst long")
    for most in (None, 2):
        kernel, loop = (frames(traverse.bfs(e, 3, plan=p, most=most)) for p in ("kernel", "loop"))
        assert kernel == loop


def test_symmetric_is_checked(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    for plan in ("kernel", "loop"):
        with pytest.raises(ValueError, match="way back"):
            traverse.bfs(e, 0, plan=plan, symmetric=True)


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_graphs_by_key_equal_single_ones(spark, plan):
    r = random.Random(5)
    rows = [(k, r.randrange(12), r.randrange(12)) for k in "xyz" for _ in range(14)]
    seeds = [("x", 1), ("x", 4), ("y", 2), ("w", 9), ("z", None)]
    e = spark.createDataFrame(rows, "k string, src long, dst long")
    got = traverse.bfs_by_key(e, spark.createDataFrame(seeds, "k string, seed long"), ["k"], plan=plan).collect()
    want = {(k, s, n, f) for k, s in seeds if s is not None for n, f in frames(traverse.bfs(e.where(e.k == k), s, plan="kernel")).items()}
    assert {(x.k, x.seed, x.id, x.frame) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("plan", ["kernel", "loop"])
def test_k_hop_and_subgraph(spark, plan):
    e = edges(spark, PATH)
    near = traverse.k_hop(e, 0, 2, plan=plan)
    assert frames(near) == {0: 0, 1: 1, 2: 2}
    assert {(r.src, r.dst) for r in traverse.induced(e, near).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert frames(traverse.k_hop(e, 0, 0, plan=plan)) == {0: 0}


def test_tube_and_its_failures(spark):
    e = edges(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (1, 4), (4, 2), (7, 8)])
    assert {r.id for r in traverse.tube(e, 0, 2, slack=0).collect()} == {1, 3}
    assert {r.id for r in traverse.tube(e, 0, 2, slack=1).collect()} == {1, 3, 4}
    assert traverse.tube_status(e, 0, 7).first().asDict() == {"status": "PIPELINE_FAILURE", "reason": "seeds are disconnected", "length": -1, "size": 0}
    assert traverse.tube_status(e, 7, 8).first().reason == "tube is empty"
    assert traverse.tube_status(e, 0, 2).first().status == "OK"
    assert traverse.tube_status(e, 0, 0).first().length == 0


def test_many_seeds_equal_single_ones(spark):
    e = edges(spark, [(i, (i * 7 + 3) % 60) for i in range(60)])
    both = traverse.bfs_multi(e, [0, 5, 9], plan="loop")
    for s in (0, 5, 9):
        assert frames(both.where(f"seed = {s}")) == frames(traverse.bfs(e, s, plan="kernel"))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(50, j) for j in range(51, 90)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200} | {j: 50 for j in range(50, 90)}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
