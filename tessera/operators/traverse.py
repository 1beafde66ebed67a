"""Breadth-first traversals: one seed, many seeds, k hops, tubes between two seeds.

These plans give the same rows. Small graphs (a checked number of edges) go to one task per group of
seeds, which builds arrays and expands levels with numpy. Larger ones use a loop of joins: the edges are written
once in buckets by source, the front moves to them, and what earlier levels hold is taken out. Up to 64 seeds
are bits of one number and share each expansion. Edges are directed unless ``symmetric`` says that each has its
way back, which is checked: then a level's neighbours lie in the two levels before it or are new, so only those
two are read. Where nodes' places are known, large graphs go zone by zone instead (``zones``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import symmetrize
from tessera.operators.tiles import MOST_SENT
from tessera.operators.zones import bfs_zones, zones
from tessera.session import checkpoint, checkpoint_root, remove, saved, temporary

#: Edges up to which the graph goes to one task: two arrays of 8 bytes an edge, 8 MB, as little as Spark would send everywhere.
KERNEL_EDGES = 500_000
FRAMES = "seed long, id long, frame int"
#: A node with more than one in so many edges is a hub, whose edges are spread over so many salts.
HUBS, SALTS = 1000, 16
#: Levels that are kept apart before they are put together.
MERGE = 16


def expand(src: np.ndarray, dst: np.ndarray, seeds: Sequence[int], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, id, frame) of every node reached from every seed."""
    ids = np.unique(np.concatenate([src, dst, np.asarray(seeds, np.int64)]))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.argsort(a, kind="stable")
    b = b[order]
    at = np.searchsorted(a[order], np.arange(len(ids) + 1))
    out = []
    for s in seeds:
        frame = np.full(len(ids), -1, np.int32)
        front, level = np.array([np.searchsorted(ids, s)]), 0
        frame[front] = 0
        while len(front) and (most is None or level < most):
            level += 1
            n = at[front + 1] - at[front]
            edges = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[front], n)
            near = b[edges]
            near = np.unique(near[frame[near] < 0])
            frame[near] = level
            front = near
        hit = np.flatnonzero(frame >= 0)
        out.append((np.full(len(hit), s, np.int64), ids[hit], frame[hit]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))


def _kernel(edges: DataFrame, seeds: Sequence[int], most: int | None) -> DataFrame:
    spark = edges.sparkSession
    groups = max(1, min(len(seeds), spark.sparkContext.defaultParallelism))
    shares = [list(seeds[i::groups]) for i in range(groups)]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s, i, f = expand(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64), shares[int(key[0])], most)
        return pd.DataFrame({"seed": s, "id": i, "frame": f})

    # a row without an edge keeps every group there when the graph is empty
    base = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    base = base.union(spark.createDataFrame([(int(seeds[0]), int(seeds[0]))], "src long, dst long"))
    return base.withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(groups)]))).groupBy("g").applyInPandas(run, FRAMES)


def _bucketed(df: DataFrame, by: Sequence[str], n: int, name: str) -> tuple[DataFrame, str, str]:
    """``df`` as a table in ``n`` buckets of ``by``, its name and its path: a join on ``by`` moves none of its rows."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark).rstrip('/')}/tessera/{table}"
    df.repartition(n, *by).write.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(table)
    temporary(spark, path)
    return spark.table(table), table, path


def _forget(spark, table: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)


def spread(edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges (keys, id, dst) with a ``salt`` that spreads the edges of each hub, and the hubs (keys, id, salts).

    A hub has more than one in ``HUBS`` of all edges, so there are at most so many.
    """
    total = edges.count()
    own = [*keys, "id"]
    hubs = checkpoint(edges.groupBy(*own).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") * HUBS > total).select(*own, F.lit(SALTS).alias("salts")))
    salted = edges.join(F.broadcast(hubs), own, "left").select(*own, "dst", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.lit(SALTS))).cast("int").alias("salt"))
    return salted, hubs


def step(front: DataFrame, edges: DataFrame, hubs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, part, id, mask) of the nodes that edges lead to from ``front``; masks of one node are put together.

    The front moves to the edges' buckets; the edges stay where they are.
    """
    own = [*keys, "id"]
    salted = front.join(F.broadcast(hubs), own, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    near = salted.hint("shuffle_hash").join(edges, [*own, "salt"])
    return near.groupBy(*keys, "part", F.col("dst").alias("id")).agg(F.bit_or("mask").alias("mask"))


def _loop(edges: DataFrame, seeds: DataFrame, most: int | None, symmetric: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Traversals from ``seeds`` (keys, seed, part, bit): 64 seeds are the bits of one row of a node, and share each expansion.

    The edges are written once, by source. What was visited is a snapshot by node and the levels since; every
    ``MERGE`` levels those are put into the next snapshot.
    """
    spark, keys = edges.sparkSession, list(keys)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, held = [*keys, "part", "id"], []
    salted, hubs = spread(edges.select(*keys, F.col("src").alias("id"), "dst"), keys)
    e, *at = _bucketed(salted, [*keys, "id", "salt"], n, "edges")
    held.append(at)
    front = saved(seeds.groupBy(*keys, "part", F.col("seed").cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "level")
    logs, recent, snapshot, frame = [], [front.withColumn("frame", F.lit(0))], None, 0
    try:
        while most is None or frame < most:
            frame += 1
            near = step(front, e, hubs, keys)
            since = recent[-2:] if symmetric else recent  # of symmetric edges a level's neighbours lie in the two levels before or are new
            known = reduce(DataFrame.unionByName, [x.select(*own, "mask") for x in since]).groupBy(*own).agg(F.bit_or("mask").alias("_m"))
            new = near.join(known, own, "left")
            seen = F.coalesce("_m", F.lit(0).cast("long"))
            if snapshot is not None and not symmetric:
                new = new.join(snapshot, own, "left")
                seen = seen.bitwiseOR(F.coalesce("_s", F.lit(0).cast("long")))
            new = new.select(*own, F.col("mask").bitwiseAND(F.bitwise_not(seen)).alias("mask")).where("mask <> 0")
            front = saved(new, "level")
            if front.isEmpty():
                break
            recent.append(front.withColumn("frame", F.lit(frame)))
            if len(recent) > MERGE:
                old, recent = recent[:-2], recent[-2:]
                logs.append(saved(reduce(DataFrame.unionByName, old), "levels"))
                if not symmetric:
                    all_ = logs[-1].select(*own, "mask") if snapshot is None else logs[-1].select(*own, "mask").unionByName(snapshot.withColumnRenamed("_s", "mask"))
                    snapshot, *at = _bucketed(all_.groupBy(*own).agg(F.bit_or("mask").alias("_s")), own, n, "visited")
                    held.append(at)
                    if len(held) > 2:
                        _forget(spark, *held.pop(1))
        found = reduce(DataFrame.unionByName, [*logs, *recent]).withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)))
        # the levels' files are small beside what their bits unfold to, so Spark must not choose which side is sent
        named = seeds.select(*keys, "part", "bit", "seed")
        found = found.join(F.broadcast(named), [*keys, "part", "bit"]) if seeds.count() <= MOST_SENT else found.hint("merge").join(named, [*keys, "part", "bit"])
        return found.select(*keys, "seed", "id", "frame")
    finally:
        for at in held:
            _forget(spark, *at)


def _check_symmetric(edges: DataFrame, keys: Sequence[str] = ()) -> None:
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    if not edges.select(*keys, "src", "dst").join(back, [*keys, "src", "dst"], "left_anti").isEmpty():
        raise ValueError("not symmetric: some edges have no way back")


def bfs_multi(edges: DataFrame, seeds: Sequence[int], most: int | None = None, nodes: DataFrame | None = None, symmetric: bool = False, plan: str = "auto", places: DataFrame | None = None) -> DataFrame:
    """(seed, id, frame) of all nodes within ``most`` hops of each seed; frame 0 is the seed.

    Raises ValueError for a seed that isn't among ``nodes`` (or, without ``nodes``, for null or no seeds), and
    where ``symmetric`` is said of edges that aren't. ``plan`` is auto, kernel, zones or loop; the rows are the same.
    ``places`` (id, x, y, z) tell where the nodes are, if edges are short there; then large graphs go zone by zone (``zones``).
    """
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    if not seeds:
        raise ValueError("no seeds")
    if nodes is not None:
        known = {r.id for r in nodes.where(F.col("id").isin(*seeds)).select("id").collect()}
        if missing := [s for s in seeds if s not in known]:
            raise ValueError(f"not nodes of the graph: {missing}")
    if symmetric:
        _check_symmetric(edges)
    if plan == "auto":
        plan = "kernel" if edges.count() <= KERNEL_EDGES else "loop" if places is None else "zones"
    if plan == "kernel":
        return _kernel(edges, seeds, most)
    if plan == "zones":
        return bfs_zones(edges, zones(places), seeds, most)
    numbered = edges.sparkSession.createDataFrame([(s, i // 64, i % 64) for i, s in enumerate(seeds)], "seed long, part int, bit int")
    return _loop(edges, numbered, most, symmetric)


def bfs_by_key(edges: DataFrame, seeds: DataFrame, keys: Sequence[str], most: int | None = None, symmetric: bool = False, plan: str = "auto") -> DataFrame:
    """(keys, seed, id, frame): traversals of many graphs (keys, src, dst) side by side from their seeds (keys, seed).

    A graph is one task where none has more than ``KERNEL_EDGES`` edges; beyond that all graphs share the loop of joins.
    """
    keys = list(keys)
    # new names, so that seeds which come from the same edges can stand beside them
    starts = seeds.select(*[F.col(k).alias(k) for k in keys], F.col("seed").cast("long").alias("seed")).where("seed is not null").distinct()
    e = edges.select(*keys, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if symmetric:
        _check_symmetric(e, keys)
    if plan == "auto":
        largest = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
        plan = "kernel" if (largest or 0) <= KERNEL_EDGES else "loop"
    if plan == "loop":
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("seed")) - 1
        numbered = checkpoint(starts.withColumn("_n", place).select(*keys, "seed", F.floor(F.col("_n") / 64).cast("int").alias("part"), (F.col("_n") % 64).cast("int").alias("bit")))
        return _loop(e, numbered, most, symmetric, keys)
    types = dict(starts.dtypes)

    def run(key, own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        s, i, f = expand(graph["src"].to_numpy(np.int64), graph["dst"].to_numpy(np.int64), own["seed"].tolist(), most)
        return pd.DataFrame({**{k: pd.Series([v] * len(s), dtype=object) for k, v in zip(keys, key)}, "seed": s, "id": i, "frame": f})

    return starts.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {FRAMES}")


def bfs(edges: DataFrame, seed: int, **named) -> DataFrame:
    """(id, frame) of all nodes reached from ``seed``."""
    return bfs_multi(edges, [seed], **named).select("id", "frame")


def with_unreached(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """Frames of all ``nodes``, -1 where unreached."""
    return nodes.select("id").join(frames, "id", "left").select("id", F.coalesce("frame", F.lit(-1)).alias("frame"))


def reach(frames: DataFrame) -> DataFrame:
    """reached, max_frame and n_frames = max_frame + 1."""
    return frames.where("frame >= 0").agg(F.count(F.lit(1)).alias("reached"), F.max("frame").alias("max_frame"), (F.max("frame") + 1).alias("n_frames"))


def level_histogram(frames: DataFrame) -> DataFrame:
    return frames.where("frame >= 0").groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


def k_hop(edges: DataFrame, seed: int, k: int, **named) -> DataFrame:
    """(id, frame) within k hops; the traversal stops there."""
    return bfs(edges, seed, most=k, **named)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def tube(edges: DataFrame, a: int, b: int, slack: int = 1, **named) -> DataFrame:
    """(id, d_a, d_b, length): nodes on walks from a to b at most ``slack`` longer than the shortest, without a and b.

    No row where b isn't reached from a.
    """
    return tube_of(checkpoint(bfs_multi(edges, [a, b], **named)), a, b, slack)


def tube_of(both: DataFrame, a: int, b: int, slack: int = 1) -> DataFrame:
    """The tube by the frames (seed, id, frame) of both its seeds."""
    left = both.where(F.col("seed") == a).select("id", F.col("frame").alias("d_a"))
    right = both.where(F.col("seed") == b).select("id", F.col("frame").alias("d_b"))
    length = F.broadcast(left.where(F.col("id") == b).select(F.col("d_a").alias("length")))  # one row at most
    return left.join(right, "id").join(length).where((F.col("d_a") + F.col("d_b") <= F.col("length") + slack) & ~F.col("id").isin(a, b)).select("id", "d_a", "d_b", "length")


def tube_status(edges: DataFrame, a: int, b: int, slack: int = 1, **named) -> DataFrame:
    """One row: status OK or PIPELINE_FAILURE with its reason, path length and tube size."""
    return status_of(checkpoint(bfs_multi(edges, [a, b], **named)), a, b, slack)


def status_of(both: DataFrame, a: int, b: int, slack: int = 1) -> DataFrame:
    """The row of ``tube_status`` by the frames (seed, id, frame) of both its seeds."""
    length = both.where((F.col("seed") == a) & (F.col("id") == b)).agg(F.max("frame").alias("length"))
    size = tube_of(both, a, b, slack).agg(F.count(F.lit(1)).alias("size"))
    reason = F.when(F.col("length").isNull(), "seeds are disconnected").when(F.col("size") == 0, "tube is empty")
    return length.join(F.broadcast(size)).select(F.when(reason.isNull(), "OK").otherwise("PIPELINE_FAILURE").alias("status"), reason.alias("reason"), F.coalesce("length", F.lit(-1)).alias("length"), "size")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of all nodes, component being the smallest id reachable."""
    from tessera.operators.components import connected_components

    found = connected_components(symmetrize(edges).select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
