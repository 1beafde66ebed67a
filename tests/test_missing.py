"""Nulls and NaN are missing in every statistic, and ranks hold where a value has more rows than a range."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators import evaluate, stats

NAN = math.nan
GIVEN = [("a", 1.0, 4.0), ("a", 2.0, -1.0), ("b", 3.0, 7.0), ("b", 4.0, 7.0), ("b", 5.0, 2.0), ("a", 6.0, 9.0), ("a", 6.0, 9.5)]
MISSING = [("a", NAN, 1.0), ("b", 2.0, NAN), ("c", NAN, NAN), ("a", None, 1.0), ("b", 3.0, None), ("c", None, NAN)]


def same(a, b):
    return len(a) == len(b) and all((x is None and y is None) or x == y or (isinstance(x, float) and math.isclose(x, y)) for x, y in zip(a, b))


STATISTICS = {
    "describe": lambda d: stats.describe(d.where("y is not null and not isnan(y)"), "x"),
    "quantiles": lambda d: stats.quantiles(d.where("y is not null and not isnan(y)"), "x", {"m": 0.5, "p": 0.9}),
    "pearson": lambda d: stats.pearson(d, "x", "y"),
    "pearson by key": lambda d: stats.pearson(d, "x", "y", ["k"]).orderBy("k"),
    "spearman": lambda d: stats.spearman(d, "x", "y"),
    "spearman by key": lambda d: stats.spearman(d, "x", "y", ["k"]).orderBy("k"),
    "group summary": lambda d: stats.group_summary(d, "k", "x", "y", least=1),
    "contributors": lambda d: stats.top_contributors(d.where("y is not null and not isnan(y)"), "x", ["k"], q=0.5),
    "movers": lambda d: stats.top_movers(d.where("x is not null and not isnan(x)"), "y", ["x"], top=30),
    "cohort": lambda d: evaluate.cohort(d.where("x is not null and not isnan(x)"), "y"),
    "ratio gate": lambda d: evaluate.ratio_gate(d.where("x is not null and not isnan(x)"), "y", 5.0),
}


@pytest.mark.parametrize("name", STATISTICS)
def test_missing_values_change_no_statistic(spark, name):
    f, kind = STATISTICS[name], "k string, x double, y double"
    whole = [tuple(r) for r in f(spark.createDataFrame(GIVEN, kind)).collect()]
    holes = [tuple(r) for r in f(spark.createDataFrame(MISSING + GIVEN, kind)).collect()]
    assert whole and len(whole) == len(holes) and all(same(a, b) for a, b in zip(whole, holes))
    assert not any(isinstance(x, float) and math.isnan(x) for r in holes for x in r)


def test_pair_cohort_leaves_missing_runs_out(spark):
    kind = "rho double, delta_rho double, total_snap_count long, tm_score double"
    rows = [(0.1 * i, 0.2 - 0.1 * i, i, 0.9 - 0.1 * i) for i in range(6)]
    holes = [(NAN, NAN, 3, NAN), (None, NAN, 4, None)]
    whole, less = (tuple(evaluate.pair_cohort(spark.createDataFrame(x, kind)).first()) for x in (rows, rows + holes))
    assert same(whole, less)


def test_ladders_have_no_answer_for_missing_figures(spark):
    d = spark.createDataFrame([(NAN, 90.0), (0.2, NAN), (None, 90.0), (0.2, None), (0.2, 90.0)], "m double, w double")
    assert [r[0] for r in d.select(evaluate.verdict(d.m, d.w)).collect()] == [None] * 4 + ["ESTABLISH"]
    assert [r[0] for r in d.select(evaluate.correlation_verdict(d.m)).collect()] == [None, "WEAK SIGNAL", None, "WEAK SIGNAL", "WEAK SIGNAL"]
    assert evaluate.cohort(d.where("m > 100 and not isnan(m)"), "m").first().asDict() == {"n": 0, "median_delta": None, "wins": 0, "losses": 0, "win_pct": None, "verdict": None}
    assert evaluate.ratio_gate(d.where("isnan(m)"), "m", 1.0).first().asDict() == {"n": 0, "median_ratio": None, "gate": "FAIL"}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_mean_ranks_of_values_that_fill_several_ranges(spark, monkeypatch, limit):
    """Half of the rows share one value, so at least two of four ranges hold nothing else."""
    monkeypatch.setattr(stats, "BROADCAST_VALUES", limit)
    rng = random.Random(2)
    rows = [(k, rng.choice([5.0, 5.0, 5.0, float(rng.randrange(12)), NAN, None]) if rng.random() < 0.9 else 5.0, i) for i, k in enumerate(["a", "a", "b", None] * 150)]
    got = stats.average_rank(spark.createDataFrame(rows, "k string, v double, i int").repartition(3), "v", "r", ["k"]).collect()
    assert got[0].__fields__ == ["k", "v", "i", "r"] and len(got) == len(rows)
    for k in ("a", "b", None):
        own = [v for kk, v, _ in rows if kk == k and v is not None and v == v]
        first, n = {v: 1 + sum(x < v for x in own) for v in set(own)}, Counter(own)
        for r in got:
            if r.k == k:
                assert r.r == (None if r.v is None or r.v != r.v else first[r.v] + (n[r.v] - 1) / 2)


def test_hot_values_meet_their_ranks_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(stats, "BROADCAST_VALUES", 0)
    out = stats.average_rank(spark.range(1000).selectExpr("cast(if(id % 2 = 0, 3, id) as double) v"), "v", "r")
    per = out.groupBy().agg({"r": "max"}).first()[0]
    assert per == 1000 and np.isclose(out.where("v = 3").first().r, 2.0 + (501 - 1) / 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan.split("Join")[1].split("\n")[0]
