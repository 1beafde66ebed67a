"""Frontier walks over node states: ratchet walk, excitable wave, snap ranks.

The ratchet walk and the wave depend on every step before, so one graph is one task; many graphs or
seeds run side by side by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.contacts import degrees_around, squared

LEDGER = "f long, n long, s byte, t byte, g double, a int"


def _walk(ids: np.ndarray, degree: np.ndarray, whole: np.ndarray, near: Callable, back: Callable, seed: int) -> tuple[list[tuple], str]:
    """Ledger (f, n, s, t, g, a) of a walk over sorted ``ids``, and why it halted.

    The best node of the queue (largest gain, then degree, then first) turns from 0 to 1 once; its
    neighbours with a gain other than 0 form the next queue. ``whole`` are a node's neighbours' degrees, added up; a node that
    turns changes the sums of the nodes that lead to it only, so a step's work is that of the degrees it touches.
    """
    at = int(np.searchsorted(ids, seed))
    queue = np.array([at] if at < len(ids) and ids[at] == seed else [], np.int64)
    turned, on, ledger = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), []

    def gain(n: np.ndarray) -> np.ndarray:
        # a turned node would leave state 1 for -1, which no neighbour has
        return np.where(turned[n], on[n], whole[n] - 2 * on[n])

    while True:
        g = gain(queue)
        if not len(queue) or g.max() <= 0:
            return ledger, "no positive gradient"
        top = int(g.max())
        best = queue[g == top]
        best = int(best[degree[best].argmax()])
        if turned[best]:
            return ledger, "best already flipped"
        turned[best] = True
        np.add.at(on, back(best), degree[best])
        queue = near(best)
        queue = queue[gain(queue) != 0]
        ledger.append((len(ledger), int(ids[best]), 0, 1, float(top), len(queue)))


def ratchet(src: np.ndarray, dst: np.ndarray, seed: int) -> tuple[list[tuple], str]:
    """The walk over edges, which are held as arrays."""
    ids = np.unique(np.concatenate([src, dst, np.array([seed], np.int64)]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)

    def rows(x: np.ndarray, y: np.ndarray) -> tuple[Callable, np.ndarray]:
        order, cut = np.lexsort((y, x)), np.r_[0, np.cumsum(np.bincount(x, minlength=len(ids)))]
        y = y[order]
        return lambda i: y[cut[i] : cut[i + 1]], np.diff(cut)

    (near, degree), (back, _) = rows(a, b), rows(b, a)
    whole = np.zeros(len(ids), np.int64)
    np.add.at(whole, a, degree[b])
    return _walk(ids, degree, whole, near, back, seed)


def ratchet_near(ids: np.ndarray, xyz: Sequence[np.ndarray], degree: np.ndarray, whole: np.ndarray, seed: int, r: float) -> tuple[list[tuple], str]:
    """The walk over the radius graph of points: a node's neighbours are looked up in a grid when it turns, and no edge is held."""
    order = np.argsort(ids, kind="stable")
    ids, degree, whole, xyz = ids[order], degree[order], whole[order], [x[order] for x in xyz]
    cell = np.stack([np.floor(x / float(r)) for x in xyz], axis=1)
    places, of = np.unique(cell, axis=0, return_inverse=True)
    held = dict(zip(map(tuple, places.tolist()), np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel(), minlength=len(places)))[:-1])))

    def near(i: int) -> np.ndarray:
        own = [held[c] for c in product(*[(c - 1, c, c + 1) for c in cell[i].tolist()]) if c in held]
        j = np.sort(np.concatenate(own))
        return j[(squared([x[i] for x in xyz], [x[j] for x in xyz]) <= float(r) * float(r)) & (j != i)]

    return _walk(ids, degree, whole, near, near, seed)


def ratchet_walk(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ledger of the walk of each key (or of the whole graph) with its halt reason.

    ``edges``: keys, src, dst (symmetric); ``seeds``: keys, seed.
    """
    keys = list(keys) or ["_all"]
    e = edges.withColumn("_all", F.lit(0)) if keys == ["_all"] else edges
    s = seeds.withColumn("_all", F.lit(0)) if keys == ["_all"] else seeds
    rows = s.select(*keys, F.col("seed").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(e.select(*keys, "src", "dst"))
    types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].isna()]
        pdf = pdf[pdf["dst"].notna()]
        ledger, why = ratchet(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64), int(own["src"].iloc[0])) if len(own) else ([], "no seed")
        out = pd.DataFrame(ledger, columns=["f", "n", "s", "t", "g", "a"])
        for k, v in zip(keys, key):
            out[k] = v
        out["halt"] = why
        return out

    out = rows.groupBy(*keys).applyInPandas(walk, f"{LEDGER}, {types}, halt string")
    return out.drop("_all")


def ratchet_walk_near(points: DataFrame, r: float, keys: Sequence[str]) -> DataFrame:
    """``ratchet_walk`` of the radius graph of points (keys, id, x, y, z) within equal keys, from the smallest id with a neighbour.

    The task of a graph holds its points, of whose edges no row is made; degrees and their sums come from blocks of all tasks.
    """
    rows = degrees_around(points, r, keys)
    types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf["id"][pdf["degree"] > 0]
        ledger, why = ratchet_near(*([pdf["id"].to_numpy(), [pdf[a].to_numpy() for a in "xyz"], pdf["degree"].to_numpy(), pdf["around"].to_numpy()]), int(linked.min()), r) if len(linked) else ([], "no seed")
        out = pd.DataFrame(ledger, columns=["f", "n", "s", "t", "g", "a"])
        for k, v in zip(keys, key):
            out[k] = v
        out["halt"] = why
        return out

    return rows.groupBy(*keys).applyInPandas(walk, f"{LEDGER}, {types}, halt string")


def first_flip(ledger: DataFrame) -> DataFrame:
    """(n, f): the first frame in which each node turned."""
    return ledger.groupBy("n").agg(F.min("f").alias("f"))


def state_histogram(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def excitable_wave(edges: DataFrame, seed: int, max_frames: int) -> DataFrame:
    """(frame, id) of the nodes that fire in each frame up to ``max_frames``.

    Firing nodes rest again before the next ones are chosen, so every resting neighbour of the
    last frame's nodes fires, the nodes they were excited by included; a wave on a symmetric graph
    with an edge at the seed never dies, which is why the number of frames must be given.
    """
    from tessera.session import checkpoint

    if max_frames < 0:
        raise ValueError("max_frames is negative")
    e = checkpoint(edges.select(F.col("src").alias("id"), "dst").repartition("id"))
    front = checkpoint(edges.sparkSession.createDataFrame([(0, int(seed))], "frame int, id long"))
    out = front
    for f in range(1, max_frames + 1):
        front = checkpoint(front.join(e, "id").select(F.col("dst").alias("id")).distinct().select(F.lit(f).alias("frame"), "id"))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def sign_align(a: Column, b: Column, product: Column) -> Column:
    """``b``, turned round where the vectors' product is negative."""
    return F.when(product < 0, -b).otherwise(b)


def snap_ranks(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds snap_rank (from 1 by dv descending, id ascending, for dv > 0; else -1) and pms (count + 1 - rank; else 0)."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.col("dv") > 0).orderBy(F.desc("dv"), "id"))
    n = F.count_if(F.col("dv") > 0).over(Window.partitionBy(*keys))
    out = values.withColumn("snap_rank", F.when(F.col("dv") > 0, rank).otherwise(-1)).withColumn("_n", n)
    return out.withColumn("pms", F.when(F.col("snap_rank") > 0, F.col("_n") + 1 - F.col("snap_rank")).otherwise(0).cast("long")).drop("_n")


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, arrival) of two walks' first arrivals (id, frame): the later one where both arrive, else -1."""
    from tessera.functions import combined_arrival

    x = a.select("id", F.col("frame").alias("fa")).join(b.select("id", F.col("frame").alias("fb")), "id", "full")
    return x.select("id", combined_arrival(F.col("fa"), F.col("fb")).alias("arrival"))
