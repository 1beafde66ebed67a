"""Readers: structure text, edge lists, CSR binaries and nested JSON."""

from tessera.sources.csr import csr_binary, csr_nodes
from tessera.sources.edges import matrix_market, read_edges, snap_edges
from tessera.sources.files import csr_size, file_lengths, pair_results, residue_index, walk_document
from tessera.sources.structure import ATOMS, atoms

__all__ = ["ATOMS", "atoms", "csr_binary", "csr_nodes", "csr_size", "file_lengths", "matrix_market", "pair_results", "read_edges", "residue_index", "snap_edges", "walk_document"]
