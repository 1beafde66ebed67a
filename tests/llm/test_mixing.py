import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def test_targets_are_capped_and_dealt_anew():
    got = mixing.targets({"a": 10.0, "b": 100.0, "c": 1000.0}, {"a": 1.0, "b": 2.0, "c": 3.0})
    assert math.isclose(sum(got.values()), 1110) and got["a"] == 30 and got["b"] == 300 and math.isclose(got["c"], 780)
    assert mixing.targets({"a": 0.0, "b": 5.0}, {"a": 1.0, "b": 2.0}) == {"a": 0.0, "b": 5.0}
    assert mixing.targets({}, {}) == {} and mixing.targets({"a": 0.0}, {"a": 1.0}) == {"a": 0.0}


def test_weights_repeat_in_code_point_order():
    assert mixing.cyclic_weights(["b", None, "a", "é", "Z"]) == {"Z": 1.0, "a": 2.0, "b": 3.0, "é": 1.0, None: 2.0}


def test_flow_fills_quotas_at_least_cost():
    got = mixing.route({("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}, {"a": 12.0, "b": 14.0})
    assert math.isclose(sum(got.values()), 26)
    cost = sum(min(max(got[p] - k * c, 0), c) * k for p, c in {("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}.items() for k in range(3))
    assert math.isclose(cost, 4)


def best(patterns, quota, copies=3):
    """(greatest flow, its least cost): each level's greatest flow is the least over cuts of sources."""
    cuts = [set(c) for n in range(len(quota) + 1) for c in itertools.combinations(quota, n)]
    top = [min(sum(quota[s] for s in cut) + sum(k * c for p, c in patterns.items() if set(p) - cut) for cut in cuts) for k in range(copies + 1)]
    return top[-1], sum(k * (top[k + 1] - top[k]) for k in range(copies))


def cost_of(taken, patterns, copies=3):
    return sum(min(max(taken[p] - k * c, 0), c) * k for p, c in patterns.items() for k in range(copies))


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_greatest_and_cheapest(seed):
    r = random.Random(seed)
    names = ["a", "b", "c", None, "d"][: 1 + seed % 5]
    patterns = {p: float(r.choice([0, r.randint(1, 20)])) for n in (1, 2, 3) for p in itertools.combinations(names, n) if r.random() < 0.6}
    quota = {s: float(r.randint(0, 40)) for s in names}
    got = mixing.route(patterns, quota, 3)
    flow, cost = best(patterns, quota)
    assert math.isclose(sum(got.values()), flow, abs_tol=1e-6) and all(0 <= f <= 3 * patterns[p] + 1e-9 for p, f in got.items())
    assert math.isclose(cost_of(got, patterns), cost, abs_tol=1e-6)
    assert mixing.route(dict(reversed(patterns.items())), quota, 3) == got


def test_flow_of_many_overlapping_patterns_ends_soon():
    r = random.Random(5)
    patterns = {tuple(sorted(r.sample(range(60), 3))): 0.0 for _ in range(6000)}
    patterns = {tuple(f"s{x:02}" for x in p): float(r.randint(1, 1000)) for p in patterns}
    quota = {f"s{x:02}": sum(patterns.values()) * r.random() / 30 for x in range(60)}
    start = time.process_time()
    got = mixing.route(patterns, quota)
    assert time.process_time() - start < 10 and math.isclose(sum(got.values()), min(sum(quota.values()), 3 * sum(patterns.values())), rel_tol=1e-9)


def test_every_source_comes_near_its_target(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    size = lambda t: len((t or "").encode().split())
    assert sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    by = {}
    for r in got:
        x = by.setdefault(r.target, [r.source_size, 0, 0])
        x[1], x[2] = x[1] + r.taken, max(x[2], r.size)
    for target, (_, taken, most) in by.items():
        assert abs(taken - target) <= most / 2 + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_documents_of_several_sources(spark):
    names = [("a",), ("a", "b"), (None, "b"), ()]
    rows = [(i, "w " * (1 + i % 5), list(names[i % 4])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    weights = {"a": 1.0, "b": 2.0, None: 4.0}
    got = {r.doc_id: r for r in mixing.mix(d, weights=weights).collect()}
    assert len(got) == 400 and all(r.taken <= 3 * r.size for r in got.values())
    own = {p: sum(1 + i % 5 for i in range(400) if names[i % 4] == p) for p in names}
    size = {s: float(sum(w for p, w in own.items() if s in p)) for s in weights}
    quota = mixing.targets(size, weights)
    patterns = {p: float(w) for p, w in own.items() if p}
    taken = {p: float(sum(r.taken for i, r in got.items() if names[i % 4] == p)) for p in patterns}
    flow, cost = best(patterns, quota)
    # each pattern's choice ends within half a document
    slack = 2.5 * len(patterns)
    assert abs(sum(taken.values()) - flow) <= slack and abs(cost_of(taken, patterns) - cost) <= 2 * slack
    for n in range(1, 4):
        for some in itertools.combinations(weights, n):
            assert sum(t for p, t in taken.items() if set(p) <= set(some)) <= sum(quota[s] for s in some) + slack
    assert all(got[i].taken == 0 and got[i].target == 0 for i in range(3, 400, 4))
    assert all(math.isclose(got[i].target, sum(quota[s] for s in names[i % 4])) for i in range(400))


def test_what_is_taken_once_more_is_first_in_the_seeded_order(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.n_words(F.col("text")), F.concat(F.lit("="), "source"))
    order = {r.doc_id: r.h % 2**64 >> 40 for r in d.select("doc_id", h.alias("h")).collect()}
    assert len(set(order.values())) == 300
    got = mixing.mix(d, carry=["source"]).collect()
    for s in "ab":
        own = sorted((r for r in got if r._c_source == s), key=lambda r: order[r.doc_id])
        total = sum(r.size for r in own)
        whole = min(3, int(own[0].target / total + 1e-9))
        left, upto, want = own[0].target - whole * total, 0, []
        ends = [k for k, r in enumerate(own) if (upto := upto + r.size) - r.size / 2 <= left] if left > 1e-9 else []
        want = [whole + (bool(ends) and k <= ends[-1]) for k in range(len(own))]
        assert [r.taken for r in own] == [w * r.size for w, r in zip(want, own)]
        assert 0 < sum(w > whole for w in want) < len(own) or whole == 3


def test_extra_columns_and_empty_tables(spark, docs, empty):
    odd = docs.withColumnsRenamed({"lang": "h", "n_chars": "pattern"})
    assert mixing.select(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where(F.col("text").isNull())).first().taken == 0


def test_the_cut_falls_inside_repeated_rows(spark):
    equal = "w " * 10
    rows = [(7, equal, "a", "x")] * 300 + [(1000 + i, "w " * 20, "b", "y") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, h string")
    got = mixing.mix(d).collect()
    for target, taken in {(r.target, sum(x.taken for x in got if x.target == r.target)) for r in got}:
        assert abs(taken - target) <= 10
    assert {r.target for r in got} == {2000.0, 4000.0} and len(got) == 450
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d).collect()))


def test_the_choice_equals_one_ordered_pass(spark, docs):
    """All of a source's whole copies, and one more of the first rows of the seeded order, to the nearest document."""
    got = mixing.mix(docs.withColumn("i", F.monotonically_increasing_id()), carry=["i"]).collect()
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        whole = min(3, int(target / own[0].source_size + 1e-9)) if own[0].source_size else 0
        more = [r for r in own if r.taken > whole * r.size]
        assert all(r.taken in (whole * r.size, (whole + 1) * r.size) for r in own)
        assert abs(sum(r.size for r in more) - (target - whole * own[0].source_size)) <= max(r.size for r in own) / 2 + 1e-6 or whole == 3


def test_too_many_patterns_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(docs)
