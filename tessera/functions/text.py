"""Residue codes and code comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter and one-letter codes of the standard amino acids.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def residue_code(name: Column, unknown: str = "X") -> Column:
    """One-letter code of a three-letter name in any case; ``unknown`` for others and null."""
    known = F.create_map(*[F.lit(x) for pair in AMINO_ACIDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(name))), F.lit(unknown))


def hamming_prefix(a: Column, b: Column, n: int = 80) -> Column:
    """Mismatches over the first ``n`` elements of two arrays, compared over the shorter one."""
    m = F.least(F.size(a), F.size(b), F.lit(n))
    pairs = F.zip_with(F.slice(a, 1, m), F.slice(b, 1, m), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
