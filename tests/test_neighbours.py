"""Exact neighbours of wide vectors by the metric index, against all distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours


def clusters(n, size, seed, copies=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size)) * 10
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, size)) * 0.3
    draw = random.Random(seed)
    for i in range(n):
        if draw.random() < copies:
            x[i] = x[draw.randrange(3)]
    return [(i * 3 + 1, x[i].tolist()) for i in range(n)]


def brute(rows, k):
    out = set()
    for i, a in rows:
        d = []
        for j, b in rows:
            if i != j:
                s = 0.0
                for p, q in zip(a, b):
                    s += (p - q) * (p - q)
                d.append((s, j))
        out |= {(i, j, s) for s, j in sorted(d)[:k]}
    return out


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"id long, embedding array<{kind}>").repartition(3)


def small(monkeypatch, cell=40, block=16, heavy=1000):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "HEAVY", heavy)


@pytest.mark.parametrize("seed,copies", [(1, 0.0), (2, 0.35)])
def test_equals_all_distances_on_64_dimensions(spark, monkeypatch, seed, copies):
    small(monkeypatch)
    rows = clusters(300, 64, seed, copies)
    got, work = neighbours.knn_metric(table(spark, rows), 5)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5) and got.count() == 5 * len(rows)
    assert work.cells > 3 and work.compared < work.pairs / 3 and work.second < work.first


def test_few_dimensions_with_ties_and_open_cells(spark, monkeypatch):
    small(monkeypatch, cell=20, block=7, heavy=10)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(6)), float(rng.randrange(6))]) for i in range(150)]
    got, work = neighbours.knn_metric(table(spark, rows, "float"), 9)
    assert {tuple(r) for r in got.collect()} == brute(rows, 9)
    assert work.second > 0 and work.cells > 1


def test_one_vector_that_holds_most_points(spark, monkeypatch):
    small(monkeypatch, heavy=4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 0.0, 0.0]) for i in range(90)] + [(1000, [-0.0, 0.0, 0.0])]
    got, work = neighbours.knn_metric(table(spark, rows), 4)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4)
    assert work.first == 31  # 30 vectors of their own, of which one equals the last, and the common one


def test_points_without_a_usable_vector_are_left_out(spark):
    bad = [(900, None), (901, [math.nan, 1.0]), (902, [math.inf, 1.0]), (903, [None, 1.0]), (None, [1.0, 1.0])]
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0])]
    assert {tuple(r) for r in neighbours.knn_metric(table(spark, rows + bad), 5)[0].collect()} == brute(rows, 5)
    assert neighbours.knn_metric(table(spark, bad), 5)[0].collect() == []
    assert neighbours.knn_metric(table(spark, rows[:1]), 5)[0].collect() == []
    with pytest.raises(ValueError, match="2 to 3 components"):
        neighbours.knn_metric(table(spark, [*rows, (4, [1.0, 2.0, 3.0])]), 2)


def test_no_table_passes_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    small(monkeypatch)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 32)
    seen = []
    for name in ("collect", "toArrow", "toPandas"):
        own = getattr(DataFrame, name)

        def counted(self, own=own, name=name):
            out = own(self)
            seen.append((name, self.columns, out.num_rows if name == "toArrow" else len(out)))
            return out

        monkeypatch.setattr(DataFrame, name, counted)
    rows = clusters(400, 8, 5)
    got, work = neighbours.knn_metric(table(spark, rows), 3)
    assert seen and max(n for *_, n in seen) <= 32
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and not [x for _, c, _ in seen if "dst" in c for x in [1]]
    assert got.select(F.count_distinct("src")).first()[0] == 400
    assert work.pairs == 400 * 400


def test_farthest_first_spreads_and_stops():
    x = np.array([[0.0], [1.0], [10.0], [10.0], [4.0]])
    assert neighbours.farthest_first(x, 3).tolist() == [[0.0], [10.0], [4.0]]
    assert neighbours.farthest_first(np.zeros((4, 2)), 3).tolist() == [[0.0, 0.0]]
