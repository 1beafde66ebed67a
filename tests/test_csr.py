"""CSR folders by ranges: partitions of any size, refused files, and exports against plain ones."""

import numpy as np
import pytest

from tessera.operators import graph
from tessera.sources import csr, csr_binary, csr_nodes


def folder(path, degrees, seed=0):
    """A CSR folder of random targets, and its edges."""
    rng = np.random.default_rng(seed)
    offsets = np.r_[0, np.cumsum(degrees)]
    indices = rng.integers(0, len(degrees), offsets[-1])
    offsets.astype("<i4").tofile(path / "offsets.bin")
    indices.astype("<i4").tofile(path / "indices.bin")
    np.zeros(len(degrees), np.int8).tofile(path / "states.bin")
    return list(zip(np.repeat(np.arange(len(degrees)), degrees).tolist(), indices.tolist()))


@pytest.mark.parametrize("rows, chunk", [(1, 2), (7, 3), (100, 1 << 18)])
def test_ranges_give_every_edge_once(spark, tmp_path, monkeypatch, rows, chunk):
    """Empty nodes at both ends and a hub that spans partitions and chunks."""
    monkeypatch.setattr(csr, "CHUNK", chunk)
    want = folder(tmp_path, [0, 0, 3, 0, 40, 1, 0, 0, 0, 5, 0])
    read = csr.CsrReader({"path": str(tmp_path), "rows": rows})
    parts = [[(a, b) for batch in read.read(p) for a, b in zip(*(c.to_pylist() for c in batch.columns))] for p in read.partitions()]
    assert [e for p in parts for e in p] == want and max(map(len, parts)) <= rows


def test_partitions_are_bounded_in_spark(spark, tmp_path):
    want = folder(tmp_path, [2, 30, 0, 8])
    got = csr_binary(spark, str(tmp_path), rows=9)
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, csr_nodes(spark, str(tmp_path), rows=3).collect())) == [(0, 0, 2), (1, 0, 30), (2, 0, 0), (3, 0, 8)]


@pytest.mark.parametrize("name, data, why", [
    ("indices.bin", b"\0" * 8, "fit together"), ("offsets.bin", b"\0" * 6, "too small"), ("offsets.bin", np.array([1, 3], "<i4").tobytes(), "fit together"),
    ("offsets.bin", np.array([0, 0], "<i4").tobytes(), "fit together"), ("states.bin", b"\0", "1 states for 2 nodes"),
])
def test_files_that_do_not_fit_are_refused_before_a_task(tmp_path, name, data, why):
    folder(tmp_path, [2, 1])
    (tmp_path / name).write_bytes(data)
    with pytest.raises(ValueError, match=why):
        csr.CsrReader({"path": str(tmp_path), "table": "nodes" if name == "states.bin" else "edges"}).partitions()


def test_offsets_that_go_down(tmp_path):
    folder(tmp_path, [2, 1])
    np.array([0, 9, 3], "<i4").tofile(tmp_path / "offsets.bin")
    read = csr.CsrReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="go down"):
        [list(read.read(p)) for p in read.partitions()]


def test_an_export_has_the_bytes_of_a_plain_one(spark, tmp_path):
    e = graph.symmetrize(graph.random_graph(spark, 60, 0.1, seed=2))
    csr.export_csr(spark.range(64), e, str(tmp_path), seed=5)
    rows = np.array(sorted(map(tuple, e.collect())))
    assert (tmp_path / "indices.bin").read_bytes() == rows[:, 1].astype("<i4").tobytes()
    offsets = np.r_[0, np.cumsum(np.bincount(rows[:, 0], minlength=64))]
    assert (tmp_path / "offsets.bin").read_bytes() == offsets.astype("<i4").tobytes()
    assert (tmp_path / "states.bin").read_bytes() == bytes(1 if i == 5 else 0 for i in range(64))
    assert sorted(map(tuple, csr_binary(spark, str(tmp_path), rows=50).collect())) == [tuple(r) for r in rows.tolist()]


def test_refused_exports_leave_no_file(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    for nodes, edges in ((spark.range(1, 3), e), (spark.range(2).union(spark.range(1)), e), (spark.range(1), e), (spark.range(2), e.selectExpr("src", "nullif(dst, 0) AS dst"))):
        with pytest.raises(ValueError):
            csr.export_csr(nodes, edges, str(tmp_path))
    bad = e.selectExpr("src", "CASE WHEN src = 1 THEN assert_true(false, 'lost') IS NULL ELSE true END AS dst")
    with pytest.raises(Exception, match="lost"):
        csr.export_csr(spark.range(2), bad, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
