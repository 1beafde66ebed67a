"""Radius graphs without edge rows: the same degrees and frames as with them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import contacts, graph, spectral, traverse


def cloud(spark, n=70, seed=3):
    r = random.Random(seed)
    rows = [("ab"[i % 2], i, *[r.uniform(-2, 2) for _ in range(3)]) for i in range(n)]
    rows += [("a", 900, 0.5, 0.0, 0.0), ("a", 901, -0.5, 0.0, 0.0), ("b", 902, float("nan"), 0.0, 0.0), ("b", 903, None, 0.0, 0.0), ("b", 904, 50.0, 0.0, 0.0), ("b", 905, 0.1, 0.1, 0.1), ("b", 906, 0.1, 0.1, 0.1)]
    return spark.createDataFrame(rows, "system string, id long, x double, y double, z double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("keys, most", [([], None), (["system"], 3)])
def test_degrees_and_frames_equal_those_of_the_edges(spark, monkeypatch, keys, most):
    if most:
        monkeypatch.setattr(contacts, "OWN_ROWS", most)
        monkeypatch.setattr(contacts, "NEAR_ROWS", 2 * most)
        monkeypatch.setattr(contacts, "PAIRS", 40)
    p = cloud(spark)
    e = graph.radius_edges(p, 1.0, keys).select(*keys, "src", "dst").checkpoint()
    want = e.groupBy(*keys, F.col("src").alias("id")).count()
    assert rows(contacts.degrees(p, 1.0, keys).where("degree > 0")) == rows(want)
    if keys:
        seeds = spark.createDataFrame([("a", 0), ("a", 900), ("b", 904), ("b", 5), ("b", None), ("a", 777)], "system string, seed long")
        assert rows(contacts.bfs(p, seeds, 1.0, keys)) == rows(traverse.bfs_by_key(e, seeds, keys))
    else:
        seeds = spark.createDataFrame([(0,), (904,), (777,)], "seed long")
        assert rows(contacts.bfs(p, seeds, 1.0)) == rows(traverse.bfs_multi(e, [0, 904, 777]))


def test_pairs_as_bits_give_the_vector_of_the_edges(monkeypatch):
    monkeypatch.setattr(spectral, "MOST_NODES", 50)
    for n, r in ((120, 4.0), (120, 1.3), (40, 1.0)):
        p = np.random.default_rng(n).normal(size=(n, 3)) * 1.26
        near = ((p[:, None] - p[None]) ** 2).sum(2) <= r * r
        np.fill_diagonal(near, False)
        v, value, parts = spectral.fiedler_vector(*np.nonzero(near), np.arange(n))
        w, got, components, edges = spectral.fiedler_near(list(p.T), r)
        assert (components, edges) == (parts, near.sum() // 2) and got == pytest.approx(value, abs=1e-9) and np.abs(v - w).max() < 1e-7


def test_spectral_runs_make_no_row_for_an_edge(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("edges were made")

    p = cloud(spark, 50).where("id < 100")
    want = rows(spectral.fiedler(graph.radius_edges(p, 2.0, ["system"]), p, "system").select("system", "id", F.round("v", 6)))
    monkeypatch.setattr(spectral, "radius_edges", refuse)
    monkeypatch.setattr(spectral, "FEW_POINTS", 5)
    assert rows(spectral.fiedler_of_points(p, 2.0, "system").select("system", "id", F.round("v", 6))) == want


@pytest.mark.parametrize("r, most", [(0.8, None), (0.5, 4)])
def test_components_equal_those_of_the_edges_and_make_none(spark, monkeypatch, r, most):
    if most:
        monkeypatch.setattr(contacts, "OWN_ROWS", most)
        monkeypatch.setattr(contacts, "NEAR_ROWS", 2 * most)
        monkeypatch.setattr(contacts, "PAIRS", 10)
    p = cloud(spark, 150).unionByName(spark.createDataFrame([("a", 950, float("inf"), 0.0, 0.0), ("a", 951, 30.0, 0.0, 0.0), ("a", 952, 30.0 + r, 0.0, 0.0)], "system string, id long, x double, y double, z double")).cache()
    want = rows(traverse.components(graph.radius_edges(p.where("id <> 950"), r).select("src", "dst"), p))
    assert len({c for _, c in want}) > 8
    assert rows(contacts.components(p, r)) == want
