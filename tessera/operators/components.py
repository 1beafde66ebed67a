"""Connected components by local contraction and alternating stars, as DataFrame plans.

Each partition first contracts the edges it holds to stars around their smallest nodes; that is often
all there is to do. Where stars of different partitions still meet, rounds of alternating stars
(large-star, then small-star) follow until every node has one edge, to a node that has none; their
number grows with the logarithm of the number of nodes. A node's neighbours are never gathered: its
smallest neighbour is found by a partially aggregated minimum and joined back, and Spark may split
that join where a node has very many edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint

#: Edges that a partition contracts at once.
CHUNK = 1 << 21


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches by them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _contract(batches):
    held, size = [], 0

    def stars():
        ids, root = local_roots(*(np.concatenate(x) for x in zip(*held)))
        own = ids != root
        return pa.record_batch([pa.array(ids[own]), pa.array(root[own])], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Pairs (u, v): link v to the smallest node m around u, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, which has none itself."""
    sides = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return sides.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges of long ids to (id, component), component being the smallest id reachable.

    Self-loops, repeated edges and nulls change nothing; a node without an edge to another node has
    no row unless it has a self-loop.
    """
    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    # loops go along as edges to their own node, so that the input is read once
    both = checkpoint(clean.mapInArrow(_with_loops, "u long, v long").distinct())
    now = both.where("u <> v")
    for _ in range(rounds):
        if _settled(now):
            break
        pairs = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(pairs, large=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = checkpoint(_star(wide, large=False).mapInArrow(_contract, "u long, v long").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("u"), "v").unionByName(both.where("u = v"))
    # of a node's rows the one with the smallest component counts: a loop names only itself
    return now.unionByName(roots).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _with_loops(batches):
    """As ``_contract``, with a row (u, u) for each self-loop."""
    def plain():
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = np.unique(u[u == v])
            if len(own):
                loops.append(own)
            yield pa.record_batch([b.column(0).filter(pa.array(u != v)), b.column(1).filter(pa.array(u != v))], names=["u", "v"])

    loops: list[np.ndarray] = []
    yield from _contract(plain())
    if loops:
        x = pa.array(np.unique(np.concatenate(loops)))
        yield pa.record_batch([x, x], names=["u", "v"])
