import math
import random

import numpy as np
import pytest

from tessera.operators import align, evaluate, stats


def test_spearman_with_ties(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 1.0), (5.0, 9.0), (None, 1.0)]
    got = stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    rx, ry = np.array([1, 2.5, 2.5, 4, 5]), np.array([2.5, 2.5, 4, 1, 5])
    assert got.n == 5 and math.isclose(got.rho, np.corrcoef(rx, ry)[0, 1])


def test_spearman_by_key_and_constant_side(spark):
    rows = [("a", float(i), float(i * i)) for i in range(20)] + [("b", 1.0, float(i)) for i in range(5)]
    got = {r.k: r.rho for r in stats.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert math.isclose(got["a"], 1.0) and got["b"] is None


@pytest.mark.parametrize("r,n", [(0.5, 10), (0.0, 10), (-0.9, 5), (0.05, 1000), (0.999, 4), (-0.2, 3)])
def test_p_values_equal_the_integral_of_the_density(r, n):
    nu = n - 2
    t = abs(r) * math.sqrt(nu / (1 - r * r))
    # substitution x = sqrt(nu) tan(a) makes the range of integration finite
    a = np.linspace(math.atan(t / math.sqrt(nu)), math.pi / 2, 400_001)
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    p = 2 * c * np.trapezoid(np.cos(a) ** (nu - 1), a)
    assert abs(stats.t_p_value(r, n) - p) < 1e-7
    assert stats.t_p_value(None, n) is None and stats.t_p_value(r, 2) is None and stats.t_p_value(1.0, n) == 0


def test_describe_interpolates(spark):
    v = [float(i * i % 37) for i in range(50)]
    got = stats.describe(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double"), "v").first()
    assert got.n == 50 and all(math.isclose(got[k], np.percentile(v, q)) for k, q in (("median", 50), ("p90", 90), ("p95", 95), ("p99", 99)))


def test_group_summary_leaves_small_groups_out(spark):
    rows = [("a", i, float(i)) for i in range(6)] + [("b", i, 100.0) for i in range(4)]
    got = stats.group_summary(spark.createDataFrame(rows, "k string, f int, d double"), "k", "f", "d").collect()
    assert [(r.k, r.n, r.median_frame, r.mean_disp) for r in got] == [("a", 6, 2.5, 2.5)]


def test_precision_recall_degenerate(spark):
    rows = [(0, 0, 0, 0), (3, 0, 0, 0), (0, 3, 0, 0), (4, 2, 1, 2), (4, 2, 0, 0)]
    got = evaluate.score(spark.createDataFrame(rows, "n_pred long, n_truth long, pred_hits long, truth_hits long")).collect()
    assert [(r.precision, r.recall, round(r.f1, 6)) for r in got] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0.25, 1, 0.4), (0, 0, 0)]


def test_windowed_hits_both_ways(spark):
    pred = spark.createDataFrame([("A", s) for s in (10, 11, 30, 50)] + [("B", 10)], "chain string, seq int")
    truth = spark.createDataFrame([("A", s) for s in (12, 28, 90)], "chain string, seq int")
    assert evaluate.windowed_hits(pred, truth).first().asDict() == {"n_pred": 5, "n_truth": 3, "pred_hits": 3, "truth_hits": 2}
    assert evaluate.windowed_hits(pred.where("seq > 99"), truth).first().n_pred == 0


def test_verdicts(spark):
    def of(deltas):
        return evaluate.cohort(spark.createDataFrame([(d,) for d in deltas], "delta double")).first()

    assert of([0.1, 0.2, 0.06, -0.1]).verdict == "ESTABLISH"
    assert of([0.0, 0.0, 0.5]).verdict == "REJECT"
    assert of([0.03, 0.04, 0.02, -0.5]).verdict == "INCONCLUSIVE"
    assert of([0.0]).losses == 1


def test_cylinder_clamps_and_breaks_ties_by_id(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 0.0), (2, 5.0, 1.0, 0.0), (3, 5.0, -1.0, 0.0), (4, -3.0, 0.0, 0.0), (5, 20.0, 0.0, 0.0)], "id long, x double, y double, z double")
    m = spark.createDataFrame([(3,)], "m int")
    got = evaluate.cylinder(p, evaluate.ends_of(p, 0, 1), m).collect()
    assert sorted((r.dist, r.id) for r in got) == [(1.0, 2), (1.0, 3), (3.0, 4)]
    same = evaluate.cylinder(p, evaluate.ends_of(p, 0, 0), m).collect()
    assert sorted((round(r.dist, 6), r.id) for r in same)[0] == (3.0, 4)


def test_kabsch_finds_a_rigid_motion_and_no_reflection(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(40, 3))
    a = 0.7
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    p = q @ r.T + [1, 2, 3]
    pairs = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(p, q)], "px double, py double, pz double, qx double, qy double, qz double")
    rt = align.kabsch(pairs)
    assert align.rmsd(align.displacements(align.apply_transform(pairs, rt))).first().rmsd < 1e-9
    assert np.allclose([rt.first()[f"r{i}{j}"] for i in range(3) for j in range(3)], r.ravel())
    flat = q @ np.diag([1, 1, -1])
    assert np.linalg.det(align.rotation((q - q.mean(0)).T @ (flat - flat.mean(0)))) > 0
    assert align.kabsch(pairs, least=100).first().r00 is None


def test_window_matching():
    assert align.match_window([5, 6, 7], [6, 7, 8]) == [(0, 0), (1, 1), (2, 2)]
    assert align.match_window([5, 5, 5], [4, 6, 7]) == [(0, 1), (1, 0), (2, 2)]
    assert align.match_window([1], [9]) == []


def test_entity_matching(spark):
    a = spark.createDataFrame([("e1", list("ABCDEFGH")), ("e2", list("ABCDEFGX")), ("e3", list("ZZZZZZZZZZZZZZZZZZZZ"))], "entity string, seq array<string>")
    b = spark.createDataFrame([("f1", list("ABCDEFGX")), ("f2", list("ABCDEFGHI")), ("f3", list("YYYYYYYYYYYYYYYYYYYY"))], "entity string, seq array<string>")
    assert {(r.ea, r.eb, r.mismatches) for r in align.entity_match(a, b).collect()} == {("e1", "f2", 0), ("e2", "f1", 0)}


def test_assignments(spark):
    rows = [("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 0.6), ("b", "y", 1.0)]
    got = align.assign_two(spark.createDataFrame(rows, "ga string, gb string, rmsd double")).collect()
    assert {(r.ga, r.gb, r.working) for r in got} == {("a", "y", True), ("b", "x", False)}


def test_greedy_assignment_goes_through_the_first_side_in_order(spark):
    rows = [("k", "a1", "x", 0.5), ("k", "a1", "y", 0.6), ("k", "a2", "x", 0.1), ("k", "a2", "y", 0.9), ("k", "a3", "z", 999.0), ("l", "a2", "x", 0.1), ("l", "a1", "z", 3.0), ("l", "a1", "y", 3.0)]
    got = align.assign_greedy(spark.createDataFrame(rows, "key string, ga string, gb string, rmsd double"), ["key"]).collect()
    assert {tuple(r) for r in got} == {("k", "a1", "x", 0.5), ("k", "a2", "y", 0.9), ("l", "a2", "x", 0.1), ("l", "a1", "y", 3.0)}


def test_entities_without_codes_meet_nothing(spark):
    a = spark.createDataFrame([("e1", []), ("e2", ["A"])], "entity string, seq array<string>")
    b = spark.createDataFrame([("f1", ["A", "B"]), ("f2", []), ("f3", ["B"])], "entity string, seq array<string>")
    assert [tuple(r) for r in align.entity_match(a, b).collect()] == [("e2", "f1", 0)]


@pytest.mark.parametrize("seed", range(4))
def test_entity_matching_equals_the_plain_greedy_choice(spark, seed):
    r = random.Random(seed)
    own = ["".join(r.choice("AB") for _ in range(r.randint(1, 14))) for _ in range(12)]
    say = lambda: list(r.choice(own)[: r.randint(1, 14)])
    a, b = ([(i * 3 + side, say()) for i in range(60)] for side in (0, 1))
    used, want = set(), []
    for ea, s in sorted(a):
        best = None
        for by in (0, -1, 1, -2, 2):
            for eb, t in sorted(b):
                if len(t) == len(s) + by and eb not in used:
                    m = sum(x != y for x, y in zip(s, t))
                    if best is None or m < best[1]:
                        best = (eb, m)
        if best is not None and best[1] <= max(8, len(s) // 5):
            used.add(best[0])
            want.append((ea, *best))
    table = lambda rows: spark.createDataFrame(rows, "entity long, seq array<string>")
    assert sorted(tuple(x) for x in align.entity_match(table(a), table(b)).collect()) == want


def test_nan_is_left_out_of_summaries(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert stats.describe(d, "v").first().asDict() == {"n": 2, "mean": 2.0, "median": 2.0, "p90": 2.8, "p95": 2.9, "p99": 2.98, "max": 3.0}


def test_quantiles_by_key_equal_numpy(spark):
    r = random.Random(4)
    rows = [(k, float(r.randint(0, 9))) for k in ("a", None, "b") for _ in range(r.randint(1, 40))] + [("none", None)]
    got = {x.k: x for x in stats.describe(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    for k in ("a", None, "b"):
        v = [x for j, x in rows if j == k]
        assert got[k].n == len(v) and all(math.isclose(got[k][n], np.percentile(v, q)) for n, q in (("median", 50), ("p90", 90), ("p95", 95), ("p99", 99)))
    assert got["none"].n == 0 and got["none"].median is None
    assert stats.quantiles(spark.createDataFrame([], "v double"), "v", {"q": 0.5}).first().q is None


def test_no_single_partition_in_the_plans(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id as double) as x", "cast(id % 7 as double) as y", "cast(0 as double) as z")
    ends = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 9, 9.0, 2.0, 0.0)], "a long, ax double, ay double, az double, b long, bx double, by double, bz double")
    plan = evaluate.cylinder(rows, ends, spark.createDataFrame([(5,)], "m int"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_correlation_ladder(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0.3,), (-0.31,), (0.15,), (-0.2,), (0.149,), (None,)], "rho double")
    assert [x[0] for x in d.select(evaluate.correlation_verdict(F.col("rho"))).collect()] == ["SIGNAL", "SIGNAL", "WEAK SIGNAL", "WEAK SIGNAL", "NO SIGNAL", None]


def test_all_pairs_are_bounded(spark, monkeypatch):
    t = spark.createDataFrame([(k, g, 0.1 * k, 0.2 * k * k, 0.3) for g in "mnop" for k in range(8)], "key int, `group` string, x double, y double, z double")
    far = t.withColumn("key", t["key"] + 100)
    assert align.all_pairs_rmsd(t, far, ["key"], least=5).count() == 16
    assert align.all_pairs_rmsd(t, far, ["key"], least=5, every=False).count() == 0
    monkeypatch.setattr(align, "MOST_PAIRS", 15)
    with pytest.raises(ValueError, match="pairs of groups"):
        align.all_pairs_rmsd(t, far, ["key"], least=5)


def test_all_pairs_rmsd_needs_shared_keys(spark):
    r = random.Random(2)
    rows = [(k, g, r.random(), r.random(), r.random()) for g in ("m", "n") for k in range(8)]
    t = spark.createDataFrame(rows, "key int, `group` string, x double, y double, z double")
    got = {(x.ga, x.gb): x.rmsd for x in align.all_pairs_rmsd(t, t, ["key"], least=5).collect()}
    assert got["m", "m"] < 1e-9 and got["m", "n"] > 0.01
    assert {x.rmsd for x in align.all_pairs_rmsd(t, t, ["key"], least=9).collect()} == {999.0}


def test_tm_score_of_equal_structures(spark):
    d = spark.createDataFrame([(0.0,)] * 100, "disp double")
    assert align.tm_score(d, 100).first().tm_score == 1.0


def test_published_scores_of_tube_and_cylinder(spark):
    # Residue numbers of a worked example, and the scores stated for it.
    truth = [179, 180, 196, 280, 152]
    tube_only = [152, 153, 174, 177, 185, 198, 266, 269, 270]
    cylinder_only = [84, 85, 86, 120, 121, 197, 217, 276, 277]
    both = [108, 109, 110, 111, 112, 175, 176, 179, 188, 189, 190, 191, 193, 194, 195, 196, 213, 214, 216, 218, 219, 220, 221, 222, 223, 224, 225, 226, 228, 229, 273]
    ids = lambda x: spark.createDataFrame([("A", i) for i in x], "chain string, seq int")
    for own, hits, found, f1 in ((tube_only, 8, 4, 0.32), (cylinder_only, 5, 3, 0.206897)):
        got = evaluate.score(evaluate.windowed_hits(ids(own + both), ids(truth))).first()
        assert (got.n_pred, got.pred_hits, got.truth_hits, round(got.f1, 6)) == (40, hits, found, f1)
