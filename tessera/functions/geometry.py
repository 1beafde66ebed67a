"""Distances, voxels and rigid transforms over coordinate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = Sequence[Column]


def _sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def squared_distance(a: Triple, b: Triple) -> Column:
    """Sum of squared differences, added in the order of the axes."""
    return _sum([(p - q) * (p - q) for p, q in zip(a, b)])


def norm(v: Triple) -> Column:
    return F.sqrt(_sum([x * x for x in v]))


def voxel(x: Column, size: float) -> Column:
    """Index of the cell that holds ``x``; floor, so negative coordinates fall in cells of equal width."""
    return F.floor(x / F.lit(float(size))).cast("long")


def segment_distance(p: Triple, a: Triple, b: Triple) -> Column:
    """Distance from a point to the segment AB; to A where A and B coincide."""
    ab = [y - x for x, y in zip(a, b)]
    length = _sum([d * d for d in ab])
    along = _sum([(q - x) * d for q, x, d in zip(p, a, ab)])
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.when(length > 0, length)))).otherwise(F.lit(0.0))
    return norm([q - (x + t * d) for q, x, d in zip(p, a, ab)])


def transform(p: Triple, r: Sequence[Triple], t: Triple) -> list[Column]:
    """R p + t, row by row."""
    return [_sum([m * x for m, x in zip(row, p)]) + s for row, s in zip(r, t)]


def displacement(p: Triple, q: Triple) -> Column:
    return norm([a - b for a, b in zip(p, q)])
