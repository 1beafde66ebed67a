"""Radius graphs of crowded cells against all pairs, and the bounds of their blocks."""

import random
from collections import Counter
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, tiles


def crowd(seed, n=160):
    """Half of the points in one cell, a sixth in one place, the rest around and far away; some on the cell's border."""
    r = random.Random(seed)
    inner = [tuple(r.uniform(-1, 0) for _ in range(3)) for _ in range(n // 2)]
    heap = [(-0.25, -0.25, -0.25)] * (n // 6)
    rest = [tuple(r.uniform(-4, 4) for _ in range(3)) for _ in range(n - n // 2 - n // 6)]
    return [*inner, *heap, *rest, (0.0, 0.0, 0.0), (-1.0, -1.0, -1.0), (1.0, -0.25, -0.25), (0.75, -0.25, -0.25)]


def brute(rows, r):
    sq = lambda a, b: reduce(add, [(p - q) * (p - q) for p, q in zip(a, b)])
    return Counter((i, j, sq(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and sq(a, b) <= r * r)


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "id long, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("seed,most", [(1, 4), (2, 11), (3, 60)])
def test_crowded_cells_give_the_same_edges(spark, seed, most):
    rows = crowd(seed)
    got = Counter((e.src, e.dst, e.d2) for e in graph.radius_edges(table(spark, rows), 1.0, most=most).collect())
    assert got == brute(rows, 1.0)


def test_keys_tables_without_broadcasts_and_missing_coordinates(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MOST_SENT", 0)
    rows = crowd(4, 60)
    d = table(spark, rows).withColumn("k", F.when(F.col("id") % 2 == 0, "even").when(F.col("id") % 4 == 1, "odd")).withColumn("n", F.lit(1))
    odd = spark.createDataFrame([(900, None, 0.0, 0.0, "even", 1), (901, float("nan"), -0.25, -0.25, "even", 1)], "id long, x double, y double, z double, k string, n int")
    got = Counter((e.src, e.dst) for e in graph.radius_edges(d.unionByName(odd), 1.0, ["k"], most=5).collect())
    name = lambda i: "even" if i % 2 == 0 else "odd" if i % 4 == 1 else None
    assert got == Counter((i, j) for i, j, _ in brute(rows, 1.0) if name(i) and name(i) == name(j))


def test_blocks_are_bounded_and_far_tiles_are_left_out(spark):
    rows, most = crowd(5, 400), 9
    p = table(spark, rows)
    dense = tiles.crowded(p, 1.0, [], ["x", "y", "z"], most)
    own = tiles.tiled(p, dense, 1.0, [], ["x", "y", "z"], most)
    found, pairs = tiles.tile_pairs(own, 1.0, [], ["x", "y", "z"])
    n = [t.n for t in found.collect()]
    # salts are hashes, so a part of one place may hold somewhat more than its share
    assert max(n) <= 3 * most and len(n) > 30
    assert 0 < pairs.count() < len(n) ** 2


def test_no_points_and_points_of_one_place(spark):
    p = table(spark, [(1, 1, 1)] * 40)
    assert graph.radius_edges(p, 0.5, most=6).count() == 40 * 39
    assert graph.radius_edges(p.where("id < 0"), 0.5).count() == 0
