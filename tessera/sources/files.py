"""File sizes and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files below ``path``, from metadata only."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def csr_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_nodes from the size of ``offsets.bin``, and n_entries of ``indices.bin``, from metadata only.

    Raises ValueError where a file is missing, the offsets are no whole number of entries or too few, or
    ``states.bin`` isn't one byte a node.
    """
    sizes = {r.name: r.length for r in file_lengths(spark, folder).where(F.col("name").isin(*CSR_FILES)).collect()}
    if missing := [f for f in CSR_FILES if f not in sizes]:
        raise ValueError(f"missing in {folder}: {missing}")
    n = sizes["offsets.bin"] // 4 - 1
    if sizes["offsets.bin"] % 4 or n < 1 or sizes["indices.bin"] % 4 or sizes["states.bin"] != n:
        raise ValueError(f"sizes don't fit together: {sizes}")
    return spark.createDataFrame([(n, sizes["indices.bin"] // 4)], "n_nodes long, n_entries long")


CSR_FILES = ("states.bin", "offsets.bin", "indices.bin")


def walk_document(spark: SparkSession, path: str) -> DataFrame:
    """Residues of a walk document, one row each: arrival from both seeds (-1 where not reached) and displacement."""
    residue = "struct<resid:int,ffA:int,ffB:int,disp:double>"
    schema = f"pdb string, seed_A_resid int, seed_B_resid int, n int, walk_A_depth int, walk_B_depth int, disp_max double, residues array<{residue}>"
    return spark.read.schema(schema).json(path, multiLine=True).select("pdb", "seed_A_resid", "seed_B_resid", "n", "walk_A_depth", "walk_B_depth", "disp_max", F.explode("residues").alias("r")).select("pdb", "seed_A_resid", "seed_B_resid", "n", "walk_A_depth", "walk_B_depth", "disp_max", "r.*")


PAIR_RESULT = (
    "id string, status string, reason string, n_matched int, n_edges_A int, n_edges_B int, n_components_A int, n_components_B int, lambda_2_A double, lambda_2_B double, "
    "hinge_seed_index int, total_snap_count int, reached_count int, rho_snap_vs_disp double, rho_euclid_vs_disp double, delta_rho double, tm_score double, rmsd_kabsch_A double"
)


def pair_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a result document of pair runs (``{"note": ..., "rows": [...]}``); fields that a failure lacks are null."""
    fields = ",".join(f"{n}:{t}" for n, t in (f.split() for f in PAIR_RESULT.split(", ")))
    return spark.read.schema(f"note string, rows array<struct<{fields}>>").json(path, multiLine=True).select("note", F.explode("rows").alias("r")).select("note", "r.*")


def residue_index(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a residue index document, one row each."""
    node = "struct<idx:bigint,entity:string,subchain:string,seq_id:int,atom:string,residue:string,x:double,y:double,z:double,b_iso:double>"
    schema = f"n_nodes int, k_neighbors int, seed_idx int, working_23s_subchain string, nodes array<{node}>"
    return spark.read.schema(schema).json(path, multiLine=True).select("n_nodes", "k_neighbors", "seed_idx", F.explode("nodes").alias("n")).select("n_nodes", "k_neighbors", "seed_idx", "n.*")
