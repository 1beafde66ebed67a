"""Graph builders: radius and k-nearest-neighbour edges, symmetric edge lists, degrees, Laplacian, CSR."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import squared_distance, voxel
from tessera.operators import contacts, tiles
from tessera.operators.neighbours import knn_metric
from tessera.session import checkpoint

XYZ = ("x", "y", "z")
#: Points that may be sent to every task.
BLOCK_POINTS = 50_000


def symmetrize(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Both directions of every edge once; self-loops stay only if asked for."""
    e = edges if loops else edges.where("src <> dst")
    return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, smaller id first, without self-loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def radius_edges(points: DataFrame, r: float, keys: Sequence[str] = (), axes: Sequence[str] = XYZ, most: int = tiles.CELL_POINTS) -> DataFrame:
    """Directed edges between points at most ``r`` apart (inclusive), both ways, within equal ``keys``.

    A grid of cells of width r: each point looks into the 27 cells around its own. The search is an
    equi-join on cell numbers with the distance as residual condition, never a cross join. Cells of more
    than ``most`` points, and what lies around them, meet tile by tile instead (``tiles``), so points that crowd
    in one cell, or in one place, are no hot key. The cells are counted first, which reads the points once more.
    """
    dense = checkpoint(tiles.crowded(points, r, keys, axes, most))
    if not (n := dense.count()):
        return _cell_edges(points, r, keys, axes)
    cells = [f"_{a}" for a in axes]
    named = points.select(*keys, "id", *axes, *[voxel(F.col(a), r).alias(f"_{a}") for a in axes])
    thin = named.join(F.broadcast(dense) if n <= tiles.MOST_SENT else dense, [*keys, *cells], "left_anti").drop(*cells)
    return _cell_edges(thin, r, keys, axes).unionByName(tiles.crowded_edges(points, dense, r, keys, axes, most))


def _cell_edges(points: DataFrame, r: float, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    cells = [voxel(F.col(a), r).alias(f"_{a}") for a in axes]
    left = points.select(*keys, F.col("id").alias("src"), *[F.col(a).alias(f"s{a}") for a in axes], *cells)
    for a in axes:
        left = left.withColumn(f"_{a}", F.explode(F.array(*[F.col(f"_{a}") + d for d in (-1, 0, 1)])))
    right = points.select(*keys, F.col("id").alias("dst"), *[F.col(a).alias(f"t{a}") for a in axes], *cells)
    d2 = squared_distance([F.col(f"s{a}") for a in axes], [F.col(f"t{a}") for a in axes])
    near = left.join(right, [*keys, *[f"_{a}" for a in axes]]).where((F.col("src") != F.col("dst")) & (d2 <= F.lit(float(r) * float(r))))
    return near.select(*keys, "src", "dst", d2.alias("d2"))


def _top_k(src: np.ndarray, own: np.ndarray, ids: np.ndarray, coords: np.ndarray, k: int, rows: int = 512, names: np.ndarray | None = None):
    """k nearest of a block by (distance, id), ``rows`` rows at a time; distances add up the axes in order.

    ``names`` are the rows' own ids where ``src`` are others.
    """
    out, names = [], src if names is None else names
    for lo in range(0, len(src), rows):
        a = own[lo : lo + rows]
        d2 = np.zeros((len(a), len(ids)))
        for j in range(coords.shape[1]):
            diff = a[:, j, None] - coords[None, :, j]
            d2 += diff * diff
        d2[names[lo : lo + rows, None] == ids[None]] = np.inf
        m = min(k, len(ids))
        cut = np.partition(d2, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero(d2 <= cut[:, None])
        order = np.lexsort((ids[j], d2[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        ok = (place < k) & np.isfinite(d2[i, j])
        out.append((src[lo : lo + rows][i[ok]], ids[j[ok]], d2[i[ok], j[ok]]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0)] * 3


def knn_blocks(points: DataFrame, k: int, axes: Sequence[str] | None = None, vector: str | None = None) -> DataFrame:
    """Exact k nearest neighbours (src, dst, d2): one block of all points where they are few, else the metric index.

    ``BLOCK_POINTS`` points are sent to every task at most. Ties go to the smaller id; a point is no neighbour of itself,
    told by id and not by distance.
    """
    names = list(axes or XYZ) if vector is None else [vector]
    p = points.select(F.col("id").cast("long").alias("id"), *names)
    if p.count() > BLOCK_POINTS:
        return knn_metric(p if vector is not None else p.select("id", F.array(*names).alias("_v")), k, vector or "_v")[0]

    def arrays(pdf: pd.DataFrame):
        ids = pdf["id"].to_numpy(np.int64)
        coords = np.stack(pdf[vector].to_numpy()).astype(np.float64) if vector is not None and len(pdf) else pdf[names].to_numpy(np.float64) if vector is None else np.empty((0, 1))
        return ids, coords

    held = points.sparkSession.sparkContext.broadcast(arrays(p.toPandas()))

    def search(batches):
        ids, coords = held.value
        for pdf in batches:
            if len(pdf) and len(ids):
                src, own = arrays(pdf)
                a, b, d = _top_k(src, own, ids, coords, k)
                yield pd.DataFrame({"src": a.astype(np.int64), "dst": b.astype(np.int64), "d2": d})

    return p.mapInPandas(search, "src long, dst long, d2 double")


def _best_of(k: int, most: float):
    """Kernel of ``Blocks.meet``: the ``k`` nearest of a block by (distance, id), at most ``most`` away, for each of its own points."""

    def kernel(rows, ids, own, others, near):
        step = max(1, contacts.PAIRS // max(1, len(others)))
        a, b = np.stack(own, axis=1) if len(ids) else np.empty((0, len(own))), np.stack(near, axis=1)
        src, dst, d2 = _top_k(np.arange(len(ids)), a, others, b, k, step, ids) if len(ids) and len(others) else [np.empty(0)] * 3
        src, dst, d2 = (x[d2 <= most] for x in (src, dst, d2))
        return rows.take(pa.array(src.astype(np.int64))).append_column("dst", pa.array(dst.astype(np.int64))).append_column("d2", pa.array(d2.astype(np.float64)))

    return kernel


def knn_grid(points: DataFrame, k: int, axes: Sequence[str] = XYZ, cell: float | None = None, rounds: int = 40) -> DataFrame:
    """Exact k nearest neighbours (src, dst, d2) in low dimension by growing cells, without a row for any other pair.

    The first cell width comes from the density between the 5 % and 95 % quantiles of each axis, so that a few
    points far away don't widen it; points whose k-th neighbour isn't within the width try again with
    twice the width. Only unresolved points meet the others again, in blocks of bounded size (``contacts``), which give ``k`` rows
    a point. Points with a coordinate that isn't a finite number are left out. After ``rounds`` doublings that leave points
    open, RuntimeError is raised.
    """
    finite = F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above it
    points = checkpoint(points.where(finite).select(F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes]))
    box = points.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(a, [0.0, 0.05, 0.95, 1.0], 1000).alias(a) for a in axes]).first()
    want = min(k, box.n - 1)
    if want < 1:
        return points.sparkSession.createDataFrame([], "src long, dst long, d2 double")
    sides = [box[a][2] - box[a][1] or box[a][3] - box[a][0] for a in axes]
    width = cell or max(max(sides), 1e-12) * (max(1.0, 2.0 * k / box.n) ** (1 / len(axes)) if box.n <= 2 * k else (2.0 * k / box.n) ** (1 / len(axes)))
    open_, done, at = points.select("id"), None, [f"_{a}" for a in axes]
    for _ in range(rounds):
        named = contacts._in_cells(points, width, (), axes).withColumn("_walk", F.lit(0).cast("long"))
        asking = checkpoint(named.join(open_, "id", "left_semi") if done is not None else named)
        cells = tiles._around(asking.select(*at).distinct(), at).distinct()
        # only what lies around the open points is near them
        near = named if done is None else named.join(tiles._sent(checkpoint(cells)), at, "left_semi")
        met = contacts.Blocks(near, (), axes).meet(asking, near, _best_of(want, width * width), ", dst long, d2 double")
        found = checkpoint(met.select(F.col("id").alias("src"), "dst", "d2"))
        # all that lie within the width were met; a point that met them in several blocks has the best of each
        sure = checkpoint(found.groupBy("src").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= want))
        rows = found.join(sure, "src")
        rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
        many = rows.where(F.col("_m") > want).withColumn("_n", rank).where(F.col("_n") <= want)
        kept = rows.where(F.col("_m") == want).select("src", "dst", "d2").unionByName(many.select("src", "dst", "d2"))
        done = kept if done is None else done.unionByName(kept)
        open_ = checkpoint(asking.select("id").join(sure.select(F.col("src").alias("id")), "id", "left_anti"))
        if open_.isEmpty():
            return done
        width *= 2
    raise RuntimeError("points are left without neighbours")


def knn_edges(points: DataFrame, k: int = 12, axes: Sequence[str] = XYZ) -> DataFrame:
    """Exact k nearest neighbours (src, dst, d2): one block while all points fit it, else the grid."""
    if points.count() <= BLOCK_POINTS // 2:
        return knn_blocks(points, k, axes)
    return knn_grid(points, k, axes)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree); with ``nodes`` those without an edge have degree 0."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return d if nodes is None else nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(deg: DataFrame) -> DataFrame:
    return deg.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("n_edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("n_isolated"), F.avg("degree").alias("mean_degree"),
    )


def laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples (i, j, v) of D - A."""
    diagonal = degrees(edges, nodes).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("degree").cast("double").alias("v"))
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("v")).unionByName(diagonal)


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours sorted)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, offset) for dense node ids: offset is the number of edges of smaller ids.

    Ids are grouped into ranges whose sums are added up first; only those sums pass through one task.
    """
    d = degrees(edges, nodes).withColumn("_g", F.col("id").bitwiseAND(F.lit(~0xFFFF)))
    before = F.coalesce(F.sum("s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy("_g").agg(F.sum("degree").alias("s")).select("_g", before.alias("_b"))
    within = F.coalesce(F.sum("degree").over(Window.partitionBy("_g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(starts, "_g").select("id", "degree", (F.col("_b") + within).cast("long").alias("offset"))


def csr_decode(adjacent: DataFrame) -> DataFrame:
    return adjacent.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))


def random_graph(spark, n: int, density: float, seed: int = 0) -> DataFrame:
    """Symmetric random edges: every row of the matrix draws the gaps between its own columns, as many as it has edges."""
    def draw(batches):
        for pdf in batches:
            for i in pdf["id"]:
                rng, last, hits = np.random.default_rng([seed, int(i)]), -1, []
                while density > 0 and last < n:
                    some = last + np.cumsum(rng.geometric(min(density, 1.0), max(16, int(1.2 * density * n))))
                    hits.append(some[some < n])
                    last = some[-1]
                hits = np.concatenate(hits) if hits else np.empty(0, np.int64)
                yield pd.DataFrame({"src": np.full(len(hits), i, np.int64), "dst": hits.astype(np.int64)})

    return symmetrize(spark.range(n).mapInPandas(draw, "src long, dst long"))
