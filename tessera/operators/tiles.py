"""Radius joins of points that crowd in few cells.

A cell of more than a bounded number of points is cut into octants, to the depth that its number asks for; what still holds
more (many points in one place) is cut by a hash of the id. These tiles carry the bounds of their points. Pairs of
tiles whose bounds are farther apart than the radius are left out, and each other pair is one block of the join, so
no task meets more than the square of the bound in one key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import squared_distance, voxel
from tessera.session import checkpoint

#: Points of a cell that meet in one task; a cell of more is cut into tiles.
CELL_POINTS = 4_096
#: Rows of a table of cells or tiles that are sent to every task; a larger one is shuffled.
MOST_SENT = 200_000
#: Halvings of a cell's width.
DEEPEST = 10


def _sent(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= MOST_SENT else d


def _around(d: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Each row once for every cell around its own, and for its own."""
    for c in cells:
        d = d.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    return d


def crowded(points: DataFrame, r: float, keys: Sequence[str], axes: Sequence[str], most: int = CELL_POINTS) -> DataFrame:
    """(keys, _axis..., n) of the cells of width ``r`` with more than ``most`` points; coordinates that are no numbers don't count."""
    numbers = points.where(F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: x.isNotNull() & ~F.isnan(x)))
    return numbers.groupBy(*keys, *[voxel(F.col(a), r).alias(f"_{a}") for a in axes]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def tiled(points: DataFrame, dense: DataFrame, r: float, keys: Sequence[str], axes: Sequence[str], most: int = CELL_POINTS) -> DataFrame:
    """Points in and around the cells of ``dense`` with their tile: keys, id, axes, _axis..., _sub, _salt, _dense."""
    cells = [f"_{a}" for a in axes]
    around = _around(dense.select(*keys, *cells), cells).distinct().join(dense, [*keys, *cells], "left")
    own = points.select(*keys, "id", *axes, *[voxel(F.col(a), r).alias(f"_{a}") for a in axes]).join(_sent(checkpoint(around)), [*keys, *cells])
    # NaN is in the cell of 0, and near nothing
    own = own.where(F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: ~F.isnan(x)))
    deep = F.when(F.col("n").isNull(), 0).otherwise(F.least(F.lit(DEEPEST), F.ceil(F.log(F.col("n") / most) / math.log(2 ** len(axes)))))
    parts = F.pow(F.lit(2.0), deep)
    sub = F.array(*[F.least(F.greatest(F.floor((F.col(a) / F.lit(float(r)) - F.col(f"_{a}")) * parts), F.lit(0)), parts - 1).cast("int") for a in axes])
    own = checkpoint(own.select(*keys, "id", *axes, *cells, F.concat_ws(",", F.transform(sub, lambda x: x.cast("string"))).alias("_sub"), F.col("n").isNotNull().alias("_dense")))
    tile = [*keys, *cells, "_sub"]
    full = checkpoint(own.where("_dense").groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_salts")).where("_salts > 1"))
    return own.join(_sent(full), tile, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")


def tile_pairs(own: DataFrame, r: float, keys: Sequence[str], axes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(tiles with their number ``_t``, bounds and n; pairs (_ta, _tb) that have a crowded side and bounds within ``r``)."""
    cells = [f"_{a}" for a in axes]
    bounds = [f(a).alias(f"{s}{a}") for a in axes for f, s in ((F.min, "lo_"), (F.max, "hi_"))]
    found = own.groupBy(*keys, *cells, "_sub", "_salt").agg(F.count(F.lit(1)).alias("n"), F.first("_dense").alias("_dense"), *bounds)
    tiles = checkpoint(found.withColumn("_t", F.monotonically_increasing_id()))
    named = lambda s: tiles.select(*keys, *cells, F.col("_t").alias(f"_t{s}"), F.col("_dense").alias(f"_dense{s}"), *[F.col(f"{e}_{a}").alias(f"{e}{s}_{a}") for a in axes for e in ("lo", "hi")])
    near = _around(named("a"), cells).join(named("b"), [*keys, *cells]).where("_densea or _denseb")
    gap = [F.greatest(F.col(f"lob_{a}") - F.col(f"hia_{a}"), F.col(f"loa_{a}") - F.col(f"hib_{a}"), F.lit(0.0)) for a in axes]
    # rounding keeps the order: no pair of points comes out nearer than the bounds of its tiles
    return tiles, near.where(squared_distance(gap, [F.lit(0.0)] * len(axes)) <= F.lit(float(r) * float(r))).select("_ta", "_tb")


def crowded_edges(points: DataFrame, dense: DataFrame, r: float, keys: Sequence[str], axes: Sequence[str], most: int = CELL_POINTS) -> DataFrame:
    """(keys, src, dst, d2): the directed edges of ``radius_edges`` that have an end in a cell of ``dense``."""
    own = checkpoint(tiled(points, dense, r, keys, axes, most))
    tiles, pairs = tile_pairs(own, r, keys, axes)
    pairs = checkpoint(pairs)
    tile = [*keys, *[f"_{a}" for a in axes], "_sub", "_salt"]
    # a tile has a bounded number of points, so no key of this join is hot
    numbered = own.join(tiles.select(*tile, "_t"), tile)
    left = numbered.select(*keys, F.col("_t").alias("_ta"), F.col("id").alias("src"), *[F.col(a).alias(f"s{a}") for a in axes]).join(pairs, "_ta")
    right = numbered.select(F.col("_t").alias("_tb"), F.col("id").alias("dst"), *[F.col(a).alias(f"t{a}") for a in axes]).join(pairs, "_tb")
    d2 = squared_distance([F.col(f"s{a}") for a in axes], [F.col(f"t{a}") for a in axes])
    return left.join(right, ["_ta", "_tb"]).where((F.col("src") != F.col("dst")) & (d2 <= F.lit(float(r) * float(r)))).select(*keys, "src", "dst", d2.alias("d2"))
