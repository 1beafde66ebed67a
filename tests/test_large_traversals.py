"""The loop of joins: edges that stay where they are, packed seeds, hubs, and levels put together on the way."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, traverse
from tessera.session import remove


def edges(spark, n=120, m=260, seed=1, hub=True):
    r = random.Random(seed)
    rows = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | ({(5, i) for i in range(n)} if hub else set())
    return spark.createDataFrame(sorted(rows), "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("symmetric", [False, True])
def test_more_seeds_than_bits_equal_the_kernel(spark, symmetric):
    e = graph.symmetrize(edges(spark)) if symmetric else edges(spark)
    seeds = [*range(70), 999]
    assert rows(traverse.bfs_multi(e, seeds, plan="loop", symmetric=symmetric)) == rows(traverse.bfs_multi(e, seeds, plan="kernel"))


def test_levels_are_put_together_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(traverse, "MERGE", 3)
    path = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(9, 2), (14, 0)], "src long, dst long")
    assert rows(traverse.bfs_multi(path, [0, 4], plan="loop")) == rows(traverse.bfs_multi(path, [0, 4], plan="kernel"))
    both = graph.symmetrize(path)
    assert rows(traverse.bfs_multi(both, [0, 4], plan="loop", symmetric=True)) == rows(traverse.bfs_multi(both, [0, 4], plan="kernel"))


def test_hubs_are_spread_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUBS", 10)
    e = edges(spark)
    salted, hubs = traverse.spread(e.select(F.col("src").alias("id"), "dst"), [])
    assert [r.id for r in hubs.collect()] == [5]
    own = salted.where("id = 5").groupBy("salt").count().collect()
    assert len(own) > traverse.SALTS // 2 and salted.count() == e.count()
    assert {r.salt for r in salted.where("id <> 5").select("salt").distinct().collect()} == {0}
    assert rows(traverse.bfs(e, 7, plan="loop")) == rows(traverse.bfs(e, 7, plan="kernel"))


def test_a_level_moves_no_edge(spark):
    """With broadcasts off no exchange and no sort stands between the scan of the edges and the join with the front."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted, hubs = traverse.spread(edges(spark).select(F.col("src").alias("id"), "dst"), [])
        e, table, path = traverse._bucketed(salted, ["id", "salt"], 4, "edges")
        front = spark.createDataFrame([(0, 5, 1), (0, 7, 2)], "part int, id long, mask long")
        plan = traverse.step(front, e, hubs, [])._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Scan parquet")].split("\n")
        scan = len(above[-1].split("FileScan")[0])
        chain, depth = [], scan
        for line in reversed(above[:-1]):  # the steps above the scan are those of ever smaller depth
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                chain.append(line.strip(" :+-"))
                depth = at
        join = next(i for i, x in enumerate(chain) if "ShuffledHashJoin" in x)
        assert join > 0 or "ShuffledHashJoin" in chain[0]
        assert not [x for x in chain[:join] if x.startswith(("Exchange", "Sort"))]
        assert "Bucketed: true" in plan and f"Scan parquet spark_catalog.default.{table}" in plan
        traverse._forget(spark, table, path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_table_is_left_and_64_seeds_share_the_expansions(spark, monkeypatch):
    calls = []
    own = traverse.step
    monkeypatch.setattr(traverse, "step", lambda *a: calls.append(1) or own(*a))
    e = edges(spark, hub=False)
    one = traverse.bfs_multi(e, [3], plan="loop")
    n = len(calls)
    many = traverse.bfs_multi(e, range(64), plan="loop")
    deepest = max(r.frame for r in many.collect())
    assert n == 1 + max(r.frame for r in one.collect()) and len(calls) - n == 1 + deepest
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]


def test_seeds_by_key(spark):
    e = edges(spark, 30, 60).withColumn("k", F.lit("a")).unionByName(edges(spark, 30, 50, 2).withColumn("k", F.lit("b")))
    seeds = spark.createDataFrame([("a", i) for i in range(66)] + [("b", 3), ("b", None), ("c", 1)], "k string, seed long")
    loop, kernel = (rows(traverse.bfs_by_key(e, seeds, ["k"], plan=p)) for p in ("loop", "kernel"))
    assert loop == kernel


def test_removing_what_is_gone_does_no_harm(spark, tmp_path):
    remove(spark, f"file://{tmp_path}/none")


def test_levels_are_not_sent_for_their_seeds(spark):
    """The files of the levels look small; only the seeds may go through the driver to all tasks."""
    found = traverse.bfs_multi(edges(spark), range(64), plan="loop")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
