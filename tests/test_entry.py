import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.n for r in rows) == 500


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["knn_graph", "radius_graph_voxel", "bfs_levels", "tube", "cylinder_top_m", "windowed_prf1", "spearman", "connected_components", "csr_offsets", "snap_rank_pms"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "orders", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).df()[names]
    assert sorted(want.itertuples(index=False, name=None)) == sorted(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect())


def test_queries_without_optional_packages(monkeypatch):
    import sys

    whole = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("tessera.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.warns(UserWarning, match="left out"):
        left = set(entry.queries())
    assert left <= whole and "knn_graph" in left and "op10_warc" not in left


def test_saved_tables_go_with_their_scope_only(spark):
    """A second thread saves while the first one's scope is open, within its own and without one."""
    import threading

    from pyspark.errors import AnalysisException

    from tessera.session import CLEANUP, saved, scratch, stored

    before, inside, seen = spark.conf.get(CLEANUP, "false"), threading.Barrier(2, timeout=120), {}

    def other():
        seen["free"] = saved(spark.range(7), "free")
        with scratch(spark):
            seen["own"] = saved(spark.range(3).repartition(2), "own")
            inside.wait()
            inside.wait()  # the first one's scope has ended meanwhile
            seen["count"] = seen["own"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        a = saved(spark.range(10).repartition(3), "one")
        kept, path = stored(a.where("id < 4"), "kept")
        assert a.count() == 10
        inside.wait()
    inside.wait()
    thread.join()
    assert seen["count"] == 3 and seen["free"].count() == 7 and kept.count() == 4 and path
    for gone in (a, seen["own"]):
        with pytest.raises(AnalysisException):
            spark.read.parquet(gone.inputFiles()[0].rsplit("/", 1)[0])
    assert spark.conf.get(CLEANUP, "false") == before


def test_a_scope_that_fails_leaves_nothing(spark):
    from pyspark.errors import AnalysisException

    from tessera.session import saved, scratch

    with pytest.raises(RuntimeError), scratch(spark):
        a = saved(spark.range(10), "one")
        raise RuntimeError
    with pytest.raises(AnalysisException):
        spark.read.parquet(a.inputFiles()[0].rsplit("/", 1)[0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cleaning_ends_with_its_last_thread(spark):
    from tessera.session import CLEANUP, _cleaning

    before = spark.conf.get(CLEANUP, "false")
    one, two = _cleaning(spark), _cleaning(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == before
