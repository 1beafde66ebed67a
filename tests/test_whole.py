"""Queries take whole inputs: fixtures on which a cut would show."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import align, spectral
from tessera.plans import registry


def _documents(spark, tmp_path, texts):
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "n_chars": [len(t or "") for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    return registry.entity_match(spark, str(tmp_path)).collect()


def _plain(texts):
    """Greedy matching over whole texts, in plain Python."""
    used, out = set(), set()
    for ea in [i for i in range(len(texts)) if i % 4 < 2 and texts[i] is not None]:
        a, best = texts[ea], None
        for rank, by in enumerate((0, -1, 1, -2, 2)):
            for eb in [i for i in range(len(texts)) if i % 4 >= 2 and texts[i] is not None and len(texts[i]) == len(a) + by and i not in used]:
                m = sum(x != y for x, y in zip(a[:80], texts[eb][:80]))
                if best is None or m < best[0]:
                    best = (m, eb)
        if best is not None and best[0] <= max(8, min(len(a), 80) // 5):
            used.add(best[1])
            out.add((ea, best[1], best[0]))
    return out


def test_entity_match_compares_whole_lengths(spark, tmp_path):
    start = "abcdefgh" * 30
    texts = [start + "x" * 10, start, start + "x" * 5000, start + "y" * 11, "short", "shorter", "shart", None, "z" * 81 + "q" * 300, "ü" * 79, "z" * 70 + "w" * 311, "ü" * 77]
    got = {(r.ea, r.eb, r.mismatches) for r in _documents(spark, tmp_path, texts)}
    assert got == _plain(texts) and (0, 3, 0) in got and 2 not in {x[1] for x in got}


def _lineitem(tmp_path, rows, names):
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet")
    return str(tmp_path)


def test_windowed_prf1_takes_all_rows(spark, tmp_path):
    # Order keys that are no multiples of 7 or 11; chains are order keys mod 50.
    rows = [(1, 1, 10), (51, 1, 11), (2, 1, 10), (3, 1, 90), (1, 2, 12), (101, 2, 8), (2, 2, 13), (4, 2, 90)]
    sf = _lineitem(tmp_path, rows, ["l_orderkey", "l_linenumber", "l_partkey"])
    pred, truth = ({(o % 50, x) for o, n, x in rows if n == k} for k in (1, 2))
    hit = lambda a, b: sum(any(c == d and abs(x - y) <= 2 for d, y in b) for c, x in a)
    got = registry.windowed_prf1(spark, sf).first()
    assert (got.n_pred, got.n_truth, got.pred_hits, got.truth_hits) == (len(pred), len(truth), hit(pred, truth), hit(truth, pred)) == (4, 4, 2, 2)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    assert con.sql(registry.ORACLES["windowed_prf1"]).df()[got.asDict().keys()].iloc[0].tolist() == list(got)


def test_all_groups_and_points_are_aligned(spark, tmp_path):
    rng = np.random.default_rng(3)
    sizes = [70, 60, 6, 4, 55, 8]
    label = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
    e = rng.normal(size=(len(label), 6)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(len(label)) * 50, "embedding": list(e), "label": label}).to_parquet(tmp_path / "embeddings.parquet")
    want = {}
    for ga in range(len(sizes)):
        for gb in range(len(sizes)):
            n = min(sizes[ga], sizes[gb])
            p, q = 10 * e[label == ga][:n, :3].astype(float), 10 * e[label == gb][:n, 3:].astype(float)
            m = align.rotation((q - q.mean(0)).T @ (p - p.mean(0)))
            d = p - p.mean(0) - (q - q.mean(0)) @ m.T
            want[ga, gb] = (n, 999.0 if n < 5 else np.sqrt((d**2).sum(1).mean()))
    got = {(r.ga, r.gb): (r.n, r.rmsd) for r in registry.all_pairs_rmsd(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    straight, crossed = (want[0, 0][1] + want[1, 1][1], want[0, 1][1] + want[1, 0][1])
    two = {(r.ga, r.gb): r.rmsd for r in registry.assign_two_copies(spark, str(tmp_path)).collect()}
    assert two.keys() == ({(0, 0), (1, 1)} if straight < crossed else {(0, 1), (1, 0)}) and all(abs(x - want[k][1]) < 1e-5 for k, x in two.items())


def test_key_intersection_takes_all_rows(spark, tmp_path):
    sf = _lineitem(tmp_path, [(1, 2), (1, 5), (2, 3), (2, 4), (3, 8), (3, 10), (4, 5), (4, 8), (4, 8)], ["l_partkey", "l_suppkey"])
    assert registry.key_intersection(spark, sf).first().n == 3


def test_large_systems_get_the_vector_of_the_dense_form(monkeypatch):
    rng = np.random.default_rng(1)
    xyz = np.r_[rng.normal(size=(260, 3)), rng.normal(size=(40, 3)) + 50]
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) < 1.2
    src, dst = np.nonzero(near & ~np.eye(len(xyz), dtype=bool))
    v, value, parts = spectral.fiedler_vector(src, dst, np.arange(len(xyz)))
    monkeypatch.setattr(spectral, "MOST_NODES", 20)
    w, other, same = spectral.fiedler_vector(src, dst, np.arange(len(xyz)))
    assert parts == same > 1 and abs(value - other) < 1e-9 and abs(abs(v @ w) - 1) < 1e-6


def test_a_system_beyond_the_dense_size():
    n = 4001
    i = np.arange(n - 1)
    v, value, parts = spectral.fiedler_vector(np.r_[i, i + 1], np.r_[i + 1, i], np.arange(n))
    want = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    assert parts == 1 and abs(value / (2 - 2 * np.cos(np.pi / n)) - 1) < 1e-5 and abs(v @ want / np.linalg.norm(want)) > 1 - 1e-8


def test_spectral_pairs_keep_failed_groups(spark, tmp_path, monkeypatch):
    e = np.random.default_rng(4).normal(size=(60, 6)).astype(np.float32) / 10
    pd.DataFrame({"vec_id": range(60), "embedding": list(e), "label": [0] * 30 + [1] * 30}).to_parquet(tmp_path / "embeddings.parquet")
    whole = spectral.fiedler

    def failing(edges, nodes, key):
        bad = spark.createDataFrame([(1, None, None, None, None, "PIPELINE_FAILURE", "why")], whole(edges, nodes, key).schema)
        return whole(edges.where("entity = 0"), nodes.where("entity = 0"), key).union(bad)

    monkeypatch.setattr(spectral, "fiedler", failing)
    got = {r.entity: (r.n, r.status, r.reason) for r in registry.spectral_pairs(spark, str(tmp_path)).collect()}
    assert got == {0: (30, "OK", None), 1: (None, "PIPELINE_FAILURE", "why")}
