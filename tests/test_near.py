"""Radius graphs within a task: no edges, bounded bits, and the pair of the dense Laplacian."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import graph, near, spectral
from tessera.plans import registry


@pytest.mark.parametrize("held", [0, 2_000, 1 << 20])
def test_products_and_components_hold_no_more_bits_than_allowed(monkeypatch, held):
    monkeypatch.setattr(near, "HELD_BYTES", held)
    p = np.random.default_rng(held).normal(size=(300, 3)) * 1.26
    p[1], p[2, 0], p[3] = np.nan, np.inf, 1e300
    with np.errstate(all="ignore"):
        close = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.8**2
    np.fill_diagonal(close, False)
    own, x = near.Near(list(p.T), 0.8), np.random.default_rng(1).normal(size=(300, 2))
    assert sum(s[4].nbytes for s in own.slices if s[4] is not None) <= held
    assert (own.degree == close.sum(1)).all() and np.allclose(own.times(x), close.sum(1)[:, None] * x - close @ x)
    label = np.arange(300)
    for _ in range(300):
        np.minimum.at(label, np.nonzero(close)[0], label[np.nonzero(close)[1]])
    assert len(set(zip(own.labels(), label))) == len(set(label)) == len(set(own.labels()))


def test_two_equal_ends_do_not_hide_a_smaller_value():
    # two leaves on one node have an exact pair of value 1; the long path's is far below
    n = 80
    a = np.r_[np.arange(n - 3), n - 3, n - 3]
    b = np.r_[np.arange(1, n - 2), n - 2, n - 1]
    lap = spectral.dense_laplacian(np.r_[a, b], np.r_[b, a], n)
    value, v = near.second_pair(lambda x: lap @ x, np.diag(lap).copy())
    values, vectors = np.linalg.eigh(lap)
    assert value == pytest.approx(values[1], abs=1e-10) and abs(abs(v @ vectors[:, 1]) - 1) < 1e-8


def test_fiedler_query_makes_no_row_for_an_edge(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    # the last system is one point after another, without an edge
    points = [(i, 0.15 * r.normal(size=3), i % 2) for i in range(160)] + [(200 + i, np.full(3, i), 2) for i in range(9)]
    pd.DataFrame({"vec_id": [p[0] for p in points], "embedding": [p[1].astype(np.float32) for p in points], "label": [p[2] for p in points]}).to_parquet(tmp_path / "embeddings.parquet")
    rows = lambda: sorted(tuple(x) for x in registry.fiedler(spark, str(tmp_path)).collect())
    want = rows()
    assert len(want) == 169 and {x[5] for x in want} == {"OK"}

    def refuse(*_):
        raise AssertionError("edges were made")

    monkeypatch.setattr(spectral, "FEW_POINTS", 5)
    monkeypatch.setattr(spectral, "radius_edges", refuse)
    monkeypatch.setattr(graph, "radius_edges", refuse)
    assert rows() == want
