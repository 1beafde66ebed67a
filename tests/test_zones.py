"""Traversals zone by zone: the rows of the other plans, and fewer rounds than levels."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, traverse, zones


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [None, 3])
def test_zones_give_the_rows_of_the_kernel_on_any_directed_graph(spark, most):
    r = random.Random(4)
    e = spark.createDataFrame(sorted({(r.randrange(60), r.randrange(60)) for _ in range(110)}), "src long, dst long")
    homes = spark.createDataFrame([(i, r.randrange(4)) for i in range(55)], "id long, zone int")
    seeds = [0, 7, 58, 999]
    assert rows(zones.bfs_zones(e, homes, seeds, most)) == rows(traverse.bfs_multi(e, seeds, most, plan="kernel"))


def test_a_long_path_takes_as_many_rounds_as_it_changes_zones(spark, monkeypatch):
    made = []
    monkeypatch.setattr(zones, "stored", lambda d, name, f=zones.stored: (made.append(name), f(d, name))[1])
    monkeypatch.setattr(zones, "ZONE_POINTS", 50)
    monkeypatch.setattr(traverse, "KERNEL_EDGES", 10)
    places = spark.range(120).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    path = graph.symmetrize(spark.range(119).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert rows(traverse.bfs(path, 0, places=places)) == [(i, i) for i in range(120)]
    assert len(made) < 12


def test_zones_hold_what_lies_together_and_cut_one_place(spark):
    r = random.Random(1)
    cloud = [(i, *[r.gauss(0, 1) for _ in "xyz"]) for i in range(400)] + [(1000 + i, 9.0, 9.0, 9.0) for i in range(300)] + [(2000, float("nan"), 0.0, 0.0), (2001, None, 0.0, 0.0)]
    got = zones.zones(spark.createDataFrame(cloud, "id long, x double, y double, z double"), most=100)
    assert got.count() == 700 and got.select("id").distinct().count() == 700
    assert max(x["count"] for x in got.groupBy("zone").count().collect()) < 200
    assert zones.zones(spark.createDataFrame([], "id long, x double, y double, z double")).isEmpty()
