"""Greedy matching in rounds against the choice one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import align
from tessera.operators.matching import take_in_order


def one_by_one(pairs, n=None, c=None):
    """Counter of (k, a, b) by going through (k, a) in order."""
    left, out = dict(c or {}), Counter()
    for k, a in sorted({(k, a) for k, a, *_ in pairs}, key=str):
        need = (n or {}).get((k, a), 1)
        for p, b in sorted((p, b) for kk, aa, b, p in pairs if (kk, aa) == (k, a)):
            got = min(need, left.get((k, b), 1))
            left[k, b] = left.get((k, b), 1) - got
            need -= got
            if got:
                out[k, a, b] += got
    return out


def table(spark, pairs):
    return spark.createDataFrame(pairs, "k string, a string, b string, p double").repartition(3)


def got(df):
    return Counter({(r.k, r.a, r.b): r.taken for r in df.collect()})


@pytest.mark.parametrize("seed", range(3))
def test_random_preferences(spark, seed):
    r = random.Random(seed)
    pairs = [(k, f"a{a:03}", f"b{b:03}", float(r.randrange(5))) for k in ("x", None) for a in range(40) for b in range(40) if r.random() < 0.2]
    out, rounds = take_in_order(table(spark, pairs), ["k"], "a", "b", ["p"])
    assert got(out) == one_by_one(pairs) and rounds < 30


def test_a_chain_of_displacements_is_followed_to_its_end(spark):
    """Each row wants the partner that the one before it is pushed to."""
    pairs = [("x", f"a{i:03}", f"b{i + d - 1:03}", float(d)) for i in range(1, 13) for d in (0, 1)] + [("x", "a000", "b000", 0.0)]
    out, rounds = take_in_order(table(spark, pairs), ["k"], "a", "b", ["p"])
    assert got(out) == one_by_one(pairs) == Counter({("x", f"a{i:03}", f"b{i:03}"): 1 for i in range(13)})
    assert 2 <= rounds <= 14


def test_like_preferences_of_all(spark):
    pairs = [("x", f"a{a}", f"b{b}", float(b)) for a in range(7) for b in range(5)]
    out, rounds = take_in_order(table(spark, pairs), ["k"], "a", "b", ["p"])
    assert got(out) == one_by_one(pairs) and sum(got(out).values()) == 5 and rounds <= 8


@pytest.mark.parametrize("seed", range(2))
def test_amounts_and_capacities(spark, seed):
    r = random.Random(seed)
    pairs = [("x", f"a{a:02}", f"b{b:02}", float(r.randrange(3))) for a in range(20) for b in range(12) if r.random() < 0.4]
    n, c = {("x", f"a{a:02}"): r.randrange(0, 6) for a in range(20)}, {("x", f"b{b:02}"): r.randrange(0, 8) for b in range(12)}
    rows = [(*p, n[p[0], p[1]], c[p[0], p[2]]) for p in pairs]
    d = spark.createDataFrame(rows, "k string, a string, b string, p double, n int, c int")
    assert got(take_in_order(d, ["k"], "a", "b", ["p"], "n", "c")[0]) == one_by_one(pairs, n, c)


def test_no_pairs_and_too_many_rounds(spark):
    d = table(spark, [("x", "a", "b", 1.0)])
    assert take_in_order(d.where("p > 5"), ["k"], "a", "b", ["p"])[0].collect() == []
    pairs = [("x", f"a{a}", f"b{b}", float(b)) for a in range(7) for b in range(7)]
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        take_in_order(table(spark, pairs), ["k"], "a", "b", ["p"], most_rounds=2)


def test_rounds_have_no_python(spark):
    d = spark.range(50).select((F.col("id") % 9).alias("ga"), (F.col("id") % 7).alias("gb"), F.rand(1).alias("rmsd")).groupBy("ga", "gb").agg(F.min("rmsd").alias("rmsd"))
    plan = align.assign_greedy(d)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_windows_with_repeated_positions(spark, seed):
    r = random.Random(seed)
    a = [(k, r.randrange(12)) for k in ("x", "y", None) for _ in range(25)]
    b = [(k, r.randrange(12)) for k in ("x", "y", None) for _ in range(20)]
    want = Counter()
    for k in ("x", "y", None):
        left, right = (sorted(s for kk, s in side if kk == k) for side in (a, b))
        want.update((k, left[i], right[j]) for i, j in align.match_window(left, right))
    make = lambda rows: spark.createDataFrame([*rows, ("x", None)], "chain string, seq_id int")
    assert Counter(tuple(x) for x in align.window_match(make(a), make(b), "chain").collect()) == want
