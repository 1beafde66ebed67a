"""Column functions; everything here stays inside generated code."""

from tessera.functions.geometry import displacement, norm, segment_distance, squared_distance, transform, voxel
from tessera.functions.states import combined_arrival, conflict, next_state, node_gradient
from tessera.functions.text import hamming_prefix, residue_code

__all__ = ["combined_arrival", "conflict", "displacement", "hamming_prefix", "next_state", "node_gradient", "norm", "residue_code", "segment_distance", "squared_distance", "transform", "voxel"]
