"""The distributed Fiedler pair against the dense one, its hubs, its failures and its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lanczos, spectral

SIZE = 120


def barbell(extra=()):
    """Two random halves with one edge between them, loops and repeated edges left in, and ``extra`` edges."""
    rng = np.random.default_rng(5)
    side = SIZE // 2 * (np.arange(5 * SIZE) % 2)
    ends = rng.integers(0, SIZE // 2, (5 * SIZE, 2)) + side[:, None]
    return np.r_[ends, [[3, SIZE // 2 + 5]], np.array(extra, np.int64).reshape(-1, 2)]


def table(spark, edges):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long")


def dense(edges, n):
    both = np.unique(np.r_[edges, edges[:, ::-1]], axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return spectral.fiedler_vector(both[:, 0], both[:, 1], np.arange(n))


CLIQUES = [(a + k, b + k) for k in (0, 10) for a in range(10) for b in range(a)] + [(3, 15)]


@pytest.mark.parametrize("edges, n, hub", [(barbell(), SIZE + 1, 100_000), (np.array(CLIQUES + [(20, 21), (21, 22), (20, 22)]), 23, 8)])
def test_equals_the_dense_pair(spark, monkeypatch, edges, n, hub):
    """One component and a lone node; then two components, with most nodes as hubs."""
    monkeypatch.setattr(lanczos, "HUB_EDGES", hub)
    v, value, parts = dense(edges, n)
    got = lanczos.fiedler_large(table(spark, edges), spark.range(n), degree=4).orderBy("id").toPandas()
    assert list(got.id) == list(range(n)) and set(got.status) == {"OK"} and set(got.n_components) == {parts}
    assert np.abs(got.v - v).max() < 1e-8 and abs(got.eigenvalue[0] - value) < 1e-10


def test_large_systems_leave_the_cohort_and_come_back(spark, monkeypatch):
    both = np.r_[CLIQUES, np.array(CLIQUES)[:, ::-1]]
    path = spark.createDataFrame([(i, j, "small") for a in range(3) for i, j in ((a, a + 1), (a + 1, a))], "src long, dst long, k string")
    edges = table(spark, both).withColumn("k", F.lit("large")).unionByName(path)
    nodes = spark.range(20).withColumn("k", F.lit("large")).unionByName(spark.range(4).withColumn("k", F.lit("small")))
    want = spectral.fiedler(edges, nodes, "k").toPandas().sort_values(["k", "id"])
    monkeypatch.setattr(spectral, "TASK_EDGES", 100)
    seen = []
    monkeypatch.setattr(spectral, "fiedler_large", lambda e, n: seen.append((e.count(), n.count())) or lanczos.fiedler_large(e, n))
    got = spectral.fiedler(edges, nodes, "k").toPandas().sort_values(["k", "id"])
    assert seen == [(len(both), 20)] and list(got.columns) == list(want.columns)
    assert list(got.k) == list(want.k) and list(got.id) == list(want.id) and set(got.status) == {"OK"}
    assert np.abs(got.v.to_numpy() - want.v.to_numpy()).max() < 1e-8


def test_no_edge_no_node_and_no_convergence(spark):
    none = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert [(r.status, r.id) for r in lanczos.fiedler_large(none, spark.range(3)).collect()] == [("PIPELINE_FAILURE", None)]
    assert lanczos.fiedler_large(none, spark.range(0)).collect() == []
    stuck = lanczos.fiedler_large(table(spark, barbell()), spark.range(SIZE), restarts=0).collect()
    assert len(stuck) == 1 and "did not converge" in stuck[0].reason


def test_complete_graphs_have_no_gap_to_filter(spark):
    """All eigenvalues above 0 are equal: the first step ends the basis."""
    got = lanczos.fiedler_large(table(spark, [(a, b) for a in range(6) for b in range(a)]), spark.range(6)).toPandas()
    assert abs(got.eigenvalue[0] - 6) < 1e-9 and abs(got.v.sum()) < 1e-9 and abs((got.v**2).sum() - 1) < 1e-9
    assert got.sort_values("id").v.iloc[0] > 0


def test_a_product_moves_sums_and_not_edges(spark):
    pairs = table(spark, barbell()).where("src <> dst").distinct()
    nodes = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    p = lanczos.Products(pairs, nodes, 1e9)
    try:
        rows = spark.range(SIZE).select("id", F.lit(1.0).alias("t"), F.lit(0.0).alias("s"), F.lit(1.0).alias("deg"))
        plan = p.once(p.once(rows))._jdf.queryExecution().executedPlan().toString()
        # one exchange brings the first vector, then one a product
        assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Bucketed: true") == 2
    finally:
        p.close()
