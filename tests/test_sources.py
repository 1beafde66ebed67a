import gzip
import json
import random
from collections import Counter

import pytest

from tessera.operators import points
from tessera.sources import atoms, csr_nodes, csr_size, pair_results, read_edges, residue_index, snap_edges, walk_document
from tessera.sources import structure
from tessera.sources.edges import n_nodes
from tessera.sources.sinks import markdown, write_document, write_frames, write_graph, write_ledger
from tessera.sources.structure import parse

# Item names of the atom_site loop.
CIF = """data_X
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 N GLY A 1 1 0.0 0.0 0.0
ATOM 2 CA GLY A 1 1 1.0 2.0 -3.5
ATOM 3 P U B 2 1 4 5 6
HETATM 4 CA CA C 3 . 7 8 9
ATOM 5 CA SER
ATOM 6 "C1'" A B 2 2 1 1 1
#
loop_
ATOM 9 CA GLY A 1 9 1 1 1
"""


def test_atom_rows():
    rows = parse(CIF)
    assert [(r["atom"], r["seq_id"], r["position"]) for r in rows] == [("N", 1, 0), ("CA", 1, 1), ("P", 1, 2), ("CA", None, 3), ("C1'", 2, 4)]
    assert (rows[1]["x"], rows[1]["y"], rows[1]["z"]) == (1.0, 2.0, -3.5)
    assert [r["group"] for r in rows] == ["ATOM"] * 3 + ["HETATM", "ATOM"]


def test_rows_without_a_header_use_fixed_places():
    assert parse("ATOM 1 x CA . GLY A 1 1 . 1.5 2.5 3.5\n")[0]["x"] == 1.5
    assert parse("") == []


def test_structures_as_tables(spark, tmp_path):
    for n in ("a.cif", "b.cif"):
        (tmp_path / n).write_text(CIF)
    a = atoms(spark, str(tmp_path))
    assert a.count() == 10 and {r.file for r in a.select("file").distinct().collect()} == {"a.cif", "b.cif"}
    only = points.backbone_atoms(a, ("CA", "P"), "ATOM")
    assert {(r.atom, r.seq_id) for r in only.collect()} == {("CA", 1), ("P", 1)}
    assert points.representatives(a.where("group = 'ATOM'")).count() == 6


def odd_structures():
    """Texts with what the format allows and what it doesn't."""
    r = random.Random(3)
    long = CIF.split("ATOM")[0] + "".join(f"ATOM {i} {r.choice(['CA', 'N', 'P'])} GLY {r.choice('AB')} 1 {r.choice([str(i), '.', '2.0', '99999999999'])} {r.choice(['1.5', '-2e1', '.5', '?', 'nan', '1d', '1e999'])} {i} 0.25\n{r.choice(['', '', 'loop_ '])}\n" for i in range(400)) + "# end\nATOM 1 CA GLY A 1 9 1 1 1\n"
    shuffled = "# first\nloop_\n_other.a\n_atom_site.label_atom_id old\nloop_\n_atom_site.Cartn_z\n_atom_site.Cartn_y\n_atom_site.Cartn_x\n_atom_site.label_atom_id\n_atom_site.group_PDB\n_atom_site.auth_asym_id\n_atom_site.B_iso_or_equiv\n"
    shuffled += "".join(f"  {k}ATOM 1 2 \"CA\" ATOM Q 7.5\t\n" for k in ("", "HET")) + "ATOM 2 3 CB ATOM\nloop_\n_atom_site.group_PDB\nATOM 4 5 . ATOM ? .\n"
    return {"long.cif": long, "shuffled.cif": shuffled, "bare.cif": "ATOM 1 x CA . GLY A 1 1 . 1.5 2.5 3.5\nATOM 1\n", "none.cif": "data_X\n# nothing\n", "empty.cif": ""}


@pytest.mark.parametrize("sent", [200_000, 0])
def test_structures_in_splits_equal_the_text_at_once(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(structure, "MOST_SENT", sent)
    texts = odd_structures()
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    names = [f.split()[0] for f in structure.ATOMS.split(", ")]
    want = Counter(tuple(({"file": n} | row)[k] for k in names) for n, t in texts.items() for row in parse(t))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = atoms(spark, str(tmp_path))
        assert Counter(map(tuple, got.collect())) == want and len(want) > 150 and got.columns == names
        plain = atoms(spark, str(tmp_path), numbered=False)
        assert Counter(map(tuple, plain.collect())) == Counter(w[:1] + w[2:] for w in want.elements())
        plan = plain.where("atom = 'CA'")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Window" not in plan and (not sent or "Exchange hashpartitioning" not in plan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edge_lists(spark, tmp_path):
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("# comment\n\n0\t1\n5 2\n")
    e = read_edges(spark, str(tmp_path / "e.txt.gz"))
    assert {(r.src, r.dst) for r in e.collect()} == {(0, 1), (5, 2)} and n_nodes(e).first().n == 6
    assert snap_edges(spark, str(tmp_path / "e.txt.gz"), 3).count() == 2
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n% c\n3 3 2\n1 2\n3 1\n")
    assert {(r.src, r.dst) for r in read_edges(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 1), (2, 0)}


def test_residue_index(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"n_nodes":2,"k_neighbors":12,"seed_idx":0,"nodes":[{"idx":0,"entity":"1","x":1.0},\n{"idx":1,"entity":"2","x":2.0}]}')
    assert [(r.idx, r.entity, r.x) for r in residue_index(spark, str(tmp_path / "r.json")).orderBy("idx").collect()] == [(0, "1", 1.0), (1, "2", 2.0)]


def test_sinks_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    write_graph(spark.range(2), e, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2
    f = spark.createDataFrame([(0, 0), (1, 1)], "id long, frame int")
    write_frames(f, str(tmp_path / "f"))
    write_ledger(f, str(tmp_path / "l"))
    write_document(f, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == spark.read.json(str(tmp_path / "l")).count() == spark.read.json(str(tmp_path / "d")).count() == 2
    assert markdown(f, "T").startswith("# T\n\n| id | frame |\n|---|---|\n| ")


def test_reports_are_whole_or_refused(spark):
    assert markdown(spark.range(300), "T").count("\n| ") == 301
    with pytest.raises(ValueError, match="more than 5 rows"):
        markdown(spark.range(6), "T", 5)


def test_graphs_are_found_in_folders(spark, tmp_path):
    (tmp_path / "g").mkdir()
    with pytest.raises(ValueError, match="no graph file"):
        read_edges(spark, str(tmp_path))
    (tmp_path / "g.txt").write_text("7 8\n")
    assert [tuple(r) for r in read_edges(spark, str(tmp_path)).collect()] == [(7, 8)]
    (tmp_path / "g" / "g.mtx").write_text("%%MatrixMarket\n3 3 1\n1 2\n")
    assert [tuple(r) for r in read_edges(spark, str(tmp_path)).collect()] == [(0, 1)]


def test_graph_folders_with_states(spark, tmp_path):
    from tessera.sources.sinks import export_csr

    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    export_csr(spark.range(4), e, str(tmp_path), seed=2)
    nodes = csr_nodes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, 0, 1), (1, 0, 2), (2, 1, 1), (3, 0, 0)]
    assert points.seed_by_state(nodes).first().id == 2
    assert tuple(csr_size(spark, str(tmp_path)).first()) == (4, 4)
    (tmp_path / "states.bin").write_bytes(b"\0\0")
    with pytest.raises(ValueError, match="fit together"):
        csr_size(spark, str(tmp_path))
    with pytest.raises(Exception, match="2 states for 4 nodes"):
        csr_nodes(spark, str(tmp_path)).collect()
    (tmp_path / "states.bin").unlink()
    with pytest.raises(ValueError, match="missing"):
        csr_size(spark, str(tmp_path))


def test_atom_selection_falls_back_only_if_empty(spark):
    rows = [("CA", "GLY", i) for i in range(3)] + [("P", "U", i) for i in range(9)] + [("CA", "CA", 99)]
    a = spark.createDataFrame(rows, "atom string, residue string, position long")
    assert points.select_atoms(a, 3).count() == 3
    assert points.select_atoms(a.where("residue <> 'GLY'"), 10).count() == 10
    with pytest.raises(ValueError, match="3 atoms"):
        points.select_atoms(a)


def test_walk_and_result_documents(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"pdb": "4AKE", "n": 2, "disp_max": 3.5, "residues": [{"resid": 1, "ffA": 0, "ffB": -1, "disp": 0.5}, {"resid": 2, "ffA": 1, "ffB": 2, "disp": None}]}, indent=1))
    got = walk_document(spark, str(tmp_path / "w.json")).collect()
    assert [(r.pdb, r.resid, r.ffA, r.ffB, r.disp) for r in got] == [("4AKE", 1, 0, -1, 0.5), ("4AKE", 2, 1, 2, None)]
    (tmp_path / "p.json").write_text(json.dumps({"note": "x", "rows": [{"id": "a", "status": "OK", "total_snap_count": 4, "tm_score": 0.5}, {"id": "b", "status": "PIPELINE_FAILURE", "reason": "too few atoms"}]}))
    assert [(r.id, r.status, r.reason, r.total_snap_count) for r in pair_results(spark, str(tmp_path / "p.json")).collect()] == [("a", "OK", None, 4), ("b", "PIPELINE_FAILURE", "too few atoms", None)]
