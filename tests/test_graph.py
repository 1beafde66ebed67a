import itertools
import random

import pytest

from tessera.operators import graph, points


def cloud(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)], "id long, x double, y double, z double")


def scatter(n, seed=1):
    r = random.Random(seed)
    out = [(r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(n)]
    return [*out, out[0], out[0], (0, 0, 0), (1, 0, 0)]


def d2(a, b):
    return sum((p - q) * (p - q) for p, q in zip(a, b))


def brute_knn(rows, k):
    return {(i, j) for i, a in enumerate(rows) for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j: (d2(a, rows[j]), j))[:k]}


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 3, 12, 200])
def test_knn_plans_agree_with_brute_force(spark, k):
    rows = scatter(60)
    want = brute_knn(rows, k)
    assert pairs(graph.knn_blocks(cloud(spark, rows), k)) == want
    assert pairs(graph.knn_grid(cloud(spark, rows), k)) == want


def test_knn_by_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_POINTS", 20)
    rows = scatter(60)
    assert pairs(graph.knn_blocks(cloud(spark, rows), 4)) == brute_knn(rows, 4)
    assert pairs(graph.knn_edges(cloud(spark, rows), 4)) == brute_knn(rows, 4)


def test_radius_counts_the_boundary_and_negative_cells(spark):
    rows = [*scatter(80), (-0.5, -0.5, -0.5), (0.5, -0.5, -0.5)]
    want = {(i, j) for i, j in itertools.permutations(range(len(rows)), 2) if d2(rows[i], rows[j]) <= 1.0}
    assert pairs(graph.radius_edges(cloud(spark, rows), 1.0)) == want


def test_degrees_and_isolated_nodes(spark):
    e = graph.symmetrize(spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "src long, dst long"))
    d = graph.degrees(e, spark.range(4))
    assert {r.id: r.degree for r in d.collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    assert graph.degree_stats(d).first().n_isolated == 2


def test_laplacian_rows_sum_to_zero(spark):
    e = graph.symmetrize(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4)], "src long, dst long"))
    sums = graph.laplacian(e, spark.range(6)).groupBy("i").sum("v").collect()
    assert len(sums) == 6 and all(r[1] == 0 for r in sums)


def test_csr_round_trip(spark, tmp_path):
    from tessera.sources import csr_binary, file_lengths
    from tessera.sources.sinks import export_csr

    e = graph.symmetrize(spark.createDataFrame([(0, 1), (1, 2), (4, 2)], "src long, dst long"))
    off = {r.id: r.offset for r in graph.csr_offsets(e, spark.range(6)).collect()}
    assert off == {0: 0, 1: 1, 2: 3, 3: 5, 4: 5, 5: 6}
    export_csr(spark.range(6), e, str(tmp_path), seed=1)
    assert pairs(csr_binary(spark, str(tmp_path))) == pairs(e)
    assert {r.name: r.length for r in file_lengths(spark, str(tmp_path)).collect()}["offsets.bin"] == 28


def test_random_graph_is_symmetric_and_repeatable(spark):
    a, b = (pairs(graph.random_graph(spark, 40, 0.1, seed=3)) for _ in range(2))
    assert a == b and a == {(j, i) for i, j in a} and a


def test_canonical_ids(spark):
    rows = [("b", 2, 1), ("a", 9, 2), ("a", 1, 3), ("b", 1, 4), ("a", 1, 5)]
    p = spark.createDataFrame(rows, "entity string, seq long, position long")
    got = {r.position: r.node for r in points.canonical_ids(p, ["entity", "seq", "position"]).collect()}
    assert got == {3: 0, 5: 1, 2: 2, 4: 3, 1: 4}


def test_first_match_and_residue_lookup(spark):
    rows = [("A", 1, "N", "GLY", 0), ("A", 1, "CA", "GLY", 1), ("A", 1, "P", "GLY", 2), ("A", 2, "P", "U", 3), ("B", 1, "CA", "foo", 4)]
    a = spark.createDataFrame([(c, s, at, r, p, 0.0, 0.0, 0.0) for c, s, at, r, p in rows], "chain string, seq_id int, atom string, residue string, position long, x double, y double, z double")
    assert {(r.chain, r.seq_id, r.atom) for r in points.representatives(a).collect()} == {("A", 1, "CA"), ("A", 2, "P"), ("B", 1, "CA")}
    ca = points.alpha_carbons(a)
    assert {(r.chain, r.one_letter) for r in ca.collect()} == {("A", "G"), ("B", "X")}
    assert points.find_residue(ca, "A", 1, "G").count() == 1 and points.find_residue(ca, "A", 1, "S").count() == 0


def test_seeds(spark):
    nodes = spark.createDataFrame([(0, 0, 0), (1, 0, 2), (2, 1, 0)], "id long, state int, degree long")
    assert points.seed_by_state(nodes).first().id == 2
    assert points.seed_by_state(nodes.where("state = 0")).first().id == 1
    assert points.seed_by_state(nodes.where("id = 0")).count() == 0
    assert points.seed_largest(spark.createDataFrame([(1, -2.0), (2, 2.0), (3, 1.0)], "id long, v double")).first().id == 1


def test_the_grid_meets_in_blocks_and_leaves_out_what_is_no_point(spark, monkeypatch):
    from tessera.operators import contacts

    monkeypatch.setattr(contacts, "OWN_ROWS", 5)
    monkeypatch.setattr(contacts, "NEAR_ROWS", 11)
    r = random.Random(8)
    rows = [(i, *[r.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(100 + i, 0.25, 0.25, 0.25) for i in range(20)] + [(200, 5.0, 0.0, 0.0)]
    missing = [(300, float("nan"), 0.0, 0.0), (301, None, 0.0, 0.0), (302, float("inf"), 0.0, 0.0)]
    points = spark.createDataFrame(rows + missing, "id long, x double, y double, z double")
    want = {(a[0], b[0]) for a in rows for b in sorted((x for x in rows if x[0] != a[0]), key=lambda x: (sum((p - q) ** 2 for p, q in zip(a[1:], x[1:])), x[0]))[:4]}
    assert {(x.src, x.dst) for x in graph.knn_grid(points, 4).collect()} == want
