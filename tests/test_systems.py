import math

import numpy as np
import pytest

from tessera.operators import align, evaluate, systems

# Published rows of ten pair runs (rho, delta_rho, snaps, TM-score); the reduction of them is stated with them.
PUBLISHED = [
    (0.10846162588883712, 0.21218456961178084, 60, 0.9432220340054657),
    (0.11026309150001126, -0.25241260489661543, 295, 0.9824339959102198),
    (0.1870804498718508, 0.19346800043124565, 363, 0.8377096709448668),
    (-0.4928394395109585, -0.2335855493365625, 218, 0.9375619991516682),
    (0.2262065742642818, -0.3192389552263726, 126, 0.6737493296927608),
    (0.1565737555958741, 0.20266545180695386, 130, 0.7690231266548295),
    (-0.2792223173994311, -0.9470954593359671, 268, 0.9300744984973442),
    (0.29556489925350865, 0.1159931196817291, 58, 0.24824668851227208),
    (0.31802995598777567, 0.26454964640813766, 185, 0.9902024214810601),
    (0.13573510756607426, 0.7220688794675485, 217, 0.6403455647685464),
]
KIND = "rho double, delta_rho double, total_snap_count long, tm_score double"


def test_published_reduction_of_pair_runs(spark):
    got = evaluate.pair_cohort(spark.createDataFrame(PUBLISHED, KIND)).first()
    assert (got.n, got.wins, got.n_tm) == (10, 6, 10) and math.isclose(got.win_pct, 60)
    assert abs(got.median_rho - 0.146154) < 1e-6 and abs(got.rho_tm + 0.357576) < 1e-6
    few = evaluate.pair_cohort(spark.createDataFrame(PUBLISHED[:4], KIND)).first()
    assert few.n == 4 and few.rho_tm is None


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(len(x))
    return np.array([out[x == v].mean() for v in x])


def plain_pair(p, q, radius):
    """One pair run on dense arrays."""
    m = align.rotation((q - q.mean(0)).T @ (p - p.mean(0)))
    q = (q - q.mean(0)) @ m.T + p.mean(0)
    disp, n, vectors, values, edges = np.linalg.norm(p - q, axis=1), len(p), [], [], []
    for c in (p, q):
        near = ((c[:, None] - c[None]) ** 2).sum(2) <= radius**2
        np.fill_diagonal(near, False)
        lap = np.diag(near.sum(1)) - near
        w, v = np.linalg.eigh(lap.astype(float))
        assert w[1] > 1e-6
        v = v[:, 1]
        vectors.append(-v if v[np.flatnonzero(np.abs(v) > 1e-9)[0]] < 0 else v)
        values.append(w[1])
        edges.append(int(near.sum()) // 2)
    a, b = vectors
    dv = (-b if a @ b < 0 else b) - a
    order = sorted(np.flatnonzero(dv > 0), key=lambda i: (-dv[i], i))
    pms = np.zeros(n)
    pms[order] = np.arange(len(order), 0, -1)
    far = np.linalg.norm(p - p[np.argmax(np.abs(a))], axis=1)
    rho, euclid = (np.corrcoef(ranks(x), ranks(disp))[0, 1] for x in (pms, far))
    d0 = max(0.5, 1.24 * (n - 15) ** (1 / 3) - 1.8)
    return {"n_edges_a": edges[0], "n_edges_b": edges[1], "lambda_a": values[0], "lambda_b": values[1], "total_snap_count": len(order), "rho": rho, "rho_euclid": euclid, "delta_rho": rho - euclid, "tm_score": (1 / (1 + (disp / d0) ** 2)).mean(), "rmsd": math.sqrt((disp**2).mean())}


def test_pair_runs_equal_plain_ones_and_failures_stay(spark):
    rng = np.random.default_rng(11)
    rows = {"a": [], "b": []}
    want = {}
    for k, n in (("one", 40), ("two", 31)):
        p = np.cumsum(rng.normal(size=(n, 3)), axis=0)
        q = p[:, [1, 0, 2]] * [1, -1, 1] + rng.normal(size=(n, 3)) * 0.6 + 3
        rows["a"] += [(k, i, *map(float, x)) for i, x in enumerate(p)]
        # the second conformer is numbered one off for a part, within the window
        rows["b"] += [(k, i + (i == n - 1), *map(float, x)) for i, x in enumerate(q)]
        want[k] = plain_pair(p, q, 4.0)
    far = [(float(100 * i), 0.0, float(i % 3)) for i in range(25)]
    for k, a, b in (("few", far[:19], far), ("apart", far, far), ("unmatched", far, [])):
        rows["a"] += [(k, i, *x) for i, x in enumerate(a)]
        rows["b"] += [(k, i if k != "unmatched" else 1000 + i, *x) for i, x in enumerate(b or far)]
    table = lambda s: spark.createDataFrame(rows[s], "system string, seq_id long, x double, y double, z double")
    got = {r.system: r for r in systems.run_pairs(table("a"), table("b"), "system", 4.0).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {
        "one": ("OK", None), "two": ("OK", None), "few": ("PIPELINE_FAILURE", "too few atoms"), "apart": ("PIPELINE_FAILURE", "empty graph at 4"), "unmatched": ("PIPELINE_FAILURE", "only 0 matched residues"),
    }
    for k, x in want.items():
        assert got[k].n == (40 if k == "one" else 31) and all(math.isclose(got[k][c], v, abs_tol=1e-7) for c, v in x.items())
    assert got["few"].rho is None and got["apart"].n is None


def test_system_runs_and_their_failures(spark):
    line = [(i, "A", i + 10, "G" if i % 2 else "A", float(5 * i), 0.0, 0.0) for i in range(8)]
    line.append((8, "A", 99, "A", 20.0, 4.0, 0.0))
    nodes = [(s, *x) for s in ("ok", "wrong", "missing", "near") for x in line] + [("split", *x[:4], x[4] + (1000 if x[0] > 3 else 0), *x[5:]) for x in line]
    seeds = [("ok", "A", 10, "A", "A", 17, "G"), ("wrong", "A", 10, "G", "A", 17, "G"), ("missing", "A", 10, "A", "B", 17, "G"), ("near", "A", 10, "A", "A", 11, "G"), ("split", "A", 10, "A", "A", 17, "G")]
    truth = [(s, "A", x) for s in ("ok", "split") for x in (12, 14, 50)]
    got = {r.system: r for r in systems.run_systems(
        spark.createDataFrame(nodes, "system string, id long, chain string, seq_id long, code string, x double, y double, z double"),
        spark.createDataFrame(seeds, "system string, chain_a string, seq_id_a long, code_a string, chain_b string, seq_id_b long, code_b string"),
        spark.createDataFrame(truth, "system string, chain string, seq_id long"), slack=0).collect()}
    assert {k: r.reason for k, r in got.items()} == {"ok": None, "wrong": "seed not found or name mismatch", "missing": "seed not found or name mismatch", "near": "empty tube", "split": "seed A and B in different components"}
    r = got["ok"]
    # radius 8: neighbours along the line, the ninth node beside the fifth and its neighbours
    assert (r.n, r.length, r.m) == (9, 7, 7) and r.n_edges == 20
    # tube: 11 to 16, all within 2 of 12 or 14, and 99; truth 12 and 14 are found
    assert (r.tube_precision, r.tube_recall) == (pytest.approx(6 / 7), pytest.approx(2 / 3)) and r.cylinder_f1 == pytest.approx(r.tube_f1) and r.delta == pytest.approx(0)
    assert got["near"].status == "PIPELINE_FAILURE" and got["near"].n is None
