"""Traversals of graphs whose nodes lie in space, zone by zone.

Points are cut into zones of bounded size that hold what lies together. A round of a traversal takes each zone that has heard
something new through all its own levels at once, and tells other zones the frames that its edges to them give; a zone that hears
a smaller frame later corrects what it had. So the rounds are as many as a shortest walk changes zones, not as many as
it has steps; they end when no zone has news.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tiles import _sent
from tessera.session import checkpoint, remove, stored

XYZ = ("x", "y", "z")
#: Points of a zone; one place with more is cut by a hash. A zone has less than twice as many.
ZONE_POINTS = 32_768
#: Halvings of each axis, by quantiles; so there are 2^18 cells at most.
DEPTH = 6
STATE = "zone long, walk int, id long, frame int, fresh boolean"
FAR = np.iinfo(np.int32).max


def zones(points: DataFrame, axes: Sequence[str] = XYZ, most: int | None = None) -> DataFrame:
    """(id, zone) of the points with finite coordinates: stretches of a Z-curve over quantiles, about ``most`` points each."""
    most = most or ZONE_POINTS
    finite = F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above it
    p = points.where(finite).select(F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes])
    cuts = p.agg(*[F.percentile_approx(a, [i / 2**DEPTH for i in range(1, 2**DEPTH)], 10_000).alias(a) for a in axes]).first()
    if cuts[axes[0]] is None:
        return p.select("id", F.lit(0).cast("long").alias("zone"))
    below = lambda a: F.filter(F.array(*[F.lit(c) for c in cuts[a]]), lambda c: c <= F.col(a))
    steps = [F.size(below(a)).cast("long") for a in axes]
    code = F.lit(0).cast("long")
    for b in range(DEPTH):
        for i in range(len(axes)):
            code = code + F.shiftleft(F.shiftright(F.col(f"_s{i}"), b).bitwiseAND(F.lit(1).cast("long")), len(axes) * b + i)
    coded = checkpoint(p.select("id", *[s.alias(f"_s{i}") for i, s in enumerate(steps)]).select("id", code.alias("_code")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a cell
    cells = checkpoint(coded.groupBy("_code").agg(F.count(F.lit(1)).alias("n")).select("_code", "n", before.alias("_b")))
    within = F.when(F.col("n") > most, F.pmod(F.xxhash64("id"), F.col("n"))).otherwise(0)
    return coded.join(_sent(cells), "_code").select("id", F.floor((F.col("_b") + within) / most).cast("long").alias("zone"))


def relax(ids: np.ndarray, at: np.ndarray, to: np.ndarray, frame: np.ndarray, fresh: np.ndarray, most: int | None) -> np.ndarray:
    """Lower ``frame`` along edges (``to`` from ``at``) from the nodes ``fresh`` on; the nodes that were expanded."""
    dirty, moved = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    dirty[fresh] = True
    while len(open_ := np.flatnonzero(dirty)):
        level = frame[open_].min()
        front = open_[frame[open_] == level]
        dirty[front], moved[front] = False, True
        if most is not None and level >= most:
            continue
        n = at[front + 1] - at[front]
        near = to[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[front], n)]
        near = near[frame[near] > level + 1]
        frame[near], dirty[near] = level + 1, True
    return np.flatnonzero(moved)


def _round(zone: int, graph: pa.Table, state: pa.Table, most: int | None) -> pa.Table:
    """The frames of a zone after its news, and the news that it has for others."""
    walk, node, known, fresh = (state[c].to_numpy() for c in ("walk", "id", "frame", "fresh"))
    out = [(np.full(len(walk[~fresh]), zone), walk[~fresh], node[~fresh], known[~fresh], False)] if not fresh.any() else []
    if fresh.any():
        src, dst, there = (graph[c].to_numpy() for c in ("src", "dst", "there"))
        own = there == zone
        ids = np.unique(np.concatenate([src, dst[own], node]))
        a, b = np.searchsorted(ids, src[own]), np.searchsorted(ids, dst[own])
        order, at = np.argsort(a, kind="stable"), np.r_[0, np.cumsum(np.bincount(a, minlength=len(ids)))]
        b = b[order]
        far, far_dst, far_zone = np.searchsorted(ids, src[~own]), dst[~own], there[~own]
        place = np.searchsorted(ids, node)
        for w in np.unique(walk):
            frame = np.full(len(ids), FAR, np.int32)
            old, new = (walk == w) & ~fresh, (walk == w) & fresh
            frame[place[old]] = known[old]
            before = frame.copy()
            np.minimum.at(frame, place[new], known[new])
            moved = relax(ids, at, b, frame, np.flatnonzero(frame < before), most)
            hit = np.flatnonzero(frame < FAR)
            out.append((np.full(len(hit), zone), np.full(len(hit), w), ids[hit], frame[hit], False))
            told = np.isin(far, moved) if most is None else np.isin(far, moved) & (frame[far] < most)
            order_ = np.lexsort((frame[far[told]], far_dst[told]))
            d = far_dst[told][order_]
            first = np.flatnonzero(np.r_[True, np.diff(d) != 0]) if len(d) else np.empty(0, np.int64)
            pick = np.flatnonzero(told)[order_][first]
            out.append((far_zone[pick], np.full(len(pick), w), far_dst[pick], frame[far[pick]] + 1, True))
    columns = [np.concatenate(x) for x in zip(*[x[:4] for x in out])]
    news = np.concatenate([np.full(len(x[0]), x[4]) for x in out])
    return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("zone", "walk", "id", "frame", "fresh"), (*columns, news), (np.int64, np.int32, np.int64, np.int32, bool))})


def bfs_zones(edges: DataFrame, homes: DataFrame, seeds: Sequence[int], most: int | None = None) -> DataFrame:
    """(seed, id, frame) of ``traverse.bfs_multi`` over edges (src, dst), by nodes' ``homes`` (id, zone).

    A task holds the edges of a zone's nodes. A node without a home is in zone 0.
    """
    from tessera.operators.traverse import _bucketed, _forget

    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = checkpoint(homes.select("id", F.col("zone").cast("long").alias("zone")))
    home = lambda c, name: homes.select(F.col("id").alias(c), F.col("zone").alias(name))
    zone = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    named = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    placed = named.join(home("src", "_z"), "src", "left").join(home("dst", "_t"), "dst", "left").select(zone("_z").alias("zone"), "src", "dst", zone("_t").alias("there"))
    e, *table = _bucketed(placed, ["zone"], n, "zones")
    walks = spark.createDataFrame([(i, int(s)) for i, s in enumerate(seeds)], "walk int, seed long")
    start = walks.select("walk", F.col("seed").alias("id")).join(homes, "id", "left")
    state, at = stored(start.select(zone("zone").alias("zone"), "walk", "id", F.lit(0).cast("int").alias("frame"), F.lit(True).alias("fresh")), "zones")

    def run(key, graph: pa.Table, rows: pa.Table) -> pa.Table:
        return _round(key[0].as_py(), graph, rows, most)

    try:
        while not (news := state.where("fresh").select("zone").distinct()).isEmpty():
            active = e.join(F.broadcast(news), "zone", "left_semi")
            old, (state, at) = at, stored(active.groupBy("zone").cogroup(state.groupBy("zone")).applyInArrow(run, STATE), "zones")
            remove(spark, old)
        return checkpoint(state.join(F.broadcast(walks), "walk").select("seed", "id", "frame"))
    finally:
        _forget(spark, *table)
        remove(spark, at)
