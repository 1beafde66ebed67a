"""Fiedler vectors, sign conventions and the spectral comparison of two conformers.

A system of points is one task that makes no edges (``near``). Of edges, it is one task up to ``TASK_EDGES``, dense up to
``MOST_NODES`` nodes and by inverse iteration beyond; a larger system is spread over all tasks. A cohort runs its systems side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import radius_edges
from tessera.operators.lanczos import fiedler_large
from tessera.operators.near import Near, second_pair
from tessera.operators.walks import sign_align, snap_ranks
from tessera.session import checkpoint

MOST_NODES = 4000
#: Points of a system of which nothing but them and a bounded number of bits is held by a task; nodes that are dense there.
TASK_POINTS, DENSE_POINTS = 1_000_000, 1_500
#: Partitions of systems of points, most of them empty where systems are few.
SYSTEM_PARTS = 400
#: Nodes up to which a system goes by its edges, of which it has few.
FEW_POINTS = 500
#: Entries of ``edges`` that one task takes: 16 bytes each, 80 MB.
TASK_EDGES = 5_000_000


def fiedler_vector(src: np.ndarray, dst: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(vector, eigenvalue, components) of D - A over ``ids``.

    The pair after as many smallest ones as there are components; the first entry above 1e-9 in size is positive.
    """
    n = len(ids)
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if (least == label).all():
            break
        label = least
    parts = len(np.unique(label))
    if n > MOST_NODES:
        v, value = sparse_pair(a, b, label)
    else:
        values, vectors = np.linalg.eigh(dense_laplacian(a, b, n))
        order = np.argsort(values, kind="stable")
        k = parts if parts < n else next((i for i in order if values[i] > 1e-6), 0)
        v, value = vectors[:, k], values[k]
    big = np.flatnonzero(np.abs(v) > 1e-9)
    return (-v if len(big) and v[big[0]] < 0 else v), float(value), parts


def dense_laplacian(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    lap = np.zeros((n, n))
    lap[a, b] = -1
    np.fill_diagonal(lap, 0)
    np.fill_diagonal(lap, -lap.sum(axis=1))
    return lap


def sparse_pair(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Vector and value of the smallest eigenvalue above 0, which is that of one of the components."""
    keep = a != b
    if not keep.any():
        raise ValueError(f"{len(label)} nodes without an edge; every vector belongs to 0")
    edges = np.unique(a[keep] * np.int64(len(label)) + b[keep])
    a, b = edges // len(label), edges % len(label)
    by_part = np.argsort(label[a], kind="stable")
    a, b = a[by_part], b[by_part]
    best = None
    for x, y in zip(*(lambda cuts: (np.r_[0, cuts], np.r_[cuts, len(a)]))(np.flatnonzero(np.diff(label[a])) + 1)):
        nodes, i = np.unique(a[x:y], return_inverse=True)
        j = np.searchsorted(nodes, b[x:y])
        if len(nodes) <= MOST_NODES:
            values, vectors = np.linalg.eigh(dense_laplacian(i, j, len(nodes)))
            value, w = values[1], vectors[:, 1]
        else:
            value, w = inverse_lanczos(i, j, len(nodes))
        if best is None or value < best[0]:
            best = (value, nodes, w)
    v = np.zeros(len(label))
    v[best[1]] = best[2]
    return v, best[0]


def inverse_lanczos(a: np.ndarray, b: np.ndarray, n: int, **named) -> tuple[float, np.ndarray]:
    """``inverse_pair`` of a connected graph by its edges; ``a`` is sorted."""
    starts, degree = np.flatnonzero(np.r_[True, np.diff(a) > 0]), np.bincount(a, minlength=n).astype(float)
    return inverse_pair(lambda x: degree * x - np.add.reduceat(x[b], starts), degree, **named)


def inverse_pair(times: Callable, degree: np.ndarray, steps: int = 24, restarts: int = 40, close: float = 1e-8, enough: float = 0.0) -> tuple[float, np.ndarray]:
    """Second smallest pair of a connected graph: Lanczos on the inverse of D - A, which ``times`` applies, across the constant vector.

    The inverse is applied by conjugate gradients; a round ends early when its best pair is within ``enough`` of the
    inverse's. Raises ValueError if the residual stays large.
    """
    n = len(degree)

    def solve(rhs):
        x, r = np.zeros(n), rhs.copy()
        z = r / degree
        p, rz, goal = z, r @ z, 1e-11 * np.linalg.norm(rhs)
        for _ in range(20 * n):
            if np.linalg.norm(r) <= goal:
                break
            lp = times(p)
            step = rz / (p @ lp)
            x, r = x + step * p, r - step * lp
            r -= r.mean()
            z = r / degree
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x - x.mean()

    v = np.random.default_rng(0).normal(size=n)
    for _ in range(restarts):
        v -= v.mean()
        q, images = [v / np.linalg.norm(v)], []
        for _ in range(steps):
            images.append(w := solve(q[-1]))
            for _ in range(2):
                w = w - np.array(q).T @ (np.array(q) @ w)
            w -= w.mean()
            norm = np.linalg.norm(w)
            if norm <= 1e-10 * np.linalg.norm(images[-1]):
                break
            if enough:
                t = np.array(q) @ np.array(images).T
                values, vectors = np.linalg.eigh((t + t.T) / 2)
                if norm * abs(vectors[-1, -1]) <= enough * values[-1]:
                    break
            q.append(w / np.linalg.norm(w))
        basis = np.array(q[: len(images)])
        t = basis @ np.array(images).T
        v = basis.T @ np.linalg.eigh((t + t.T) / 2)[1][:, -1]
        v = (v - v.mean()) / np.linalg.norm(v - v.mean())
        lv = times(v)
        value = v @ lv
        if np.linalg.norm(lv - value * v) <= close * max(value, 1e-4):
            return value, v
    raise ValueError(f"{n} nodes; inverse iteration did not converge")


def fiedler(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, id, v, eigenvalue, n_components, status, reason) of every node of every system.

    A system that fails becomes one row with status PIPELINE_FAILURE and the reason; the others go on. Systems of more
    than ``TASK_EDGES`` edges are solved by ``fiedler_large``, one after the other, and never grouped.
    """
    kind = dict(nodes.dtypes)[key]
    large = [r[0] for r in edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TASK_EDGES).select(key).collect()]
    if large:
        solved = []
        for k in large:
            own = F.col(key).eqNullSafe(F.lit(k))
            solved.append(fiedler_large(edges.where(own), nodes.where(own).select("id")).select(F.lit(k).cast(kind).alias(key), "*"))
            edges, nodes = edges.where(~own), nodes.where(~own)
        return reduce(DataFrame.unionByName, [*solved, fiedler(edges, nodes, key)])
    rows = nodes.select(key, F.col("id").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select(key, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    names = [key, "id", "v", "eigenvalue", "n_components", "status", "reason"]

    def solve(k, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["src"].to_numpy(np.int64))
        e = pdf[pdf["dst"].notna()]
        try:
            v, value, parts = fiedler_vector(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), ids)
            text = lambda x: pd.Series([x] * len(ids), dtype=object)
            return pd.DataFrame({key: text(k[0]), "id": ids, "v": v, "eigenvalue": value, "n_components": parts, "status": text("OK"), "reason": text(None)})
        except (ValueError, np.linalg.LinAlgError) as error:
            return pd.DataFrame([[k[0], None, None, None, None, "PIPELINE_FAILURE", str(error)]], columns=names, dtype=object)

    return rows.groupBy(key).applyInPandas(solve, f"`{key}` {kind}, id long, v double, eigenvalue double, n_components int, status string, reason string")


def fiedler_near(xyz: Sequence[np.ndarray], r: float) -> tuple[np.ndarray, float, int, int]:
    """``fiedler_vector`` of the radius graph of points, and its edges, none of which is made."""
    return _fiedler_of(Near(xyz, r))


def _fiedler_of(near: Near) -> tuple[np.ndarray, float, int, int]:
    n, label, dense = near.n, near.labels(), min(MOST_NODES, DENSE_POINTS)
    edges, parts = int(near.degree.sum()) // 2, len(np.unique(label))

    def lowest(nodes: np.ndarray, k: Callable) -> tuple[float, np.ndarray]:
        values, vectors = np.linalg.eigh(near.laplacian(nodes))
        i = k(values)
        return values[i], vectors[:, i]

    def spread(nodes: np.ndarray) -> tuple[float, np.ndarray]:
        def times(x: np.ndarray) -> np.ndarray:
            z = np.zeros((n, x.shape[1]))
            z[nodes] = x
            return near.times(z)[nodes]

        return second_pair(times, near.degree[nodes].astype(float))

    if n <= dense:
        value, v = lowest(np.arange(n), lambda values: parts if parts < n else next((i for i in range(n) if values[i] > 1e-6), 0))
    elif parts == n:
        raise ValueError(f"{n} nodes without an edge; every vector belongs to 0")
    else:
        found, names = [], np.argsort(label, kind="stable")
        for nodes in np.split(names, np.flatnonzero(np.diff(label[names])) + 1):
            if len(nodes) > 1:
                found.append((*(lowest(nodes, lambda _: 1) if len(nodes) <= dense else spread(nodes)), nodes))
        value, w, nodes = min(found, key=lambda x: x[0])
        v = np.zeros(n)
        v[nodes] = w
    big = np.flatnonzero(np.abs(v) > 1e-9)
    return (-v if len(big) and v[big[0]] < 0 else v), float(value), parts, edges


def fiedler_of_points(nodes: DataFrame, r: float, key: str, every: bool = False) -> DataFrame:
    """``fiedler`` of the radius graphs of nodes (key, id, x, y, z), with n_edges; rows for a system without an edge only with ``every``.

    A system of more than ``FEW_POINTS`` nodes is one task up to ``TASK_POINTS``, which holds the points and no row for
    any edge. Smaller and larger systems go by their edges.
    """
    kind = dict(nodes.dtypes)[key]
    sizes = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    listed = F.broadcast(checkpoint(sizes.where(~F.col("_n").between(FEW_POINTS + 1, TASK_POINTS)).select(key)))
    names = [key, "id", "v", "eigenvalue", "n_components", "status", "reason", "n_edges"]

    def solve(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xyz = [pdf[a].to_numpy(np.float64) for a in "xyz"]
        text = lambda x: pd.Series([x] * len(pdf), dtype=object)
        near = Near(xyz, r)
        try:
            v, value, parts, edges = _fiedler_of(near)
        except (ValueError, np.linalg.LinAlgError) as error:
            edges = int(near.degree.sum()) // 2
            return pd.DataFrame([[k[0], None, None, None, None, "PIPELINE_FAILURE", str(error), edges]] if edges or every else [], columns=names, dtype=object)
        out = pd.DataFrame({key: text(k[0]), "id": pdf["id"].to_numpy(), "v": v, "eigenvalue": value, "n_components": parts, "status": text("OK"), "reason": text(None), "n_edges": edges})
        return out if edges or every else out.iloc[:0]

    middle = nodes.join(listed, key, "left_anti").select(key, F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    # a system is little data and much work: by number, the partitions stay as many as there are
    spread = max(SYSTEM_PARTS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = middle.repartition(spread, key).groupBy(key).applyInPandas(solve, f"`{key}` {kind}, id long, v double, eigenvalue double, n_components int, status string, reason string, n_edges long")
    if listed.isEmpty():
        return out
    rest = nodes.join(listed, key, "left_semi")
    edges = checkpoint(radius_edges(rest, r, [key]).select(key, "src", "dst"))
    count = edges.groupBy(key).agg((F.count(F.lit(1)) / 2).cast("long").alias("n_edges"))
    if not every:
        return out.unionByName(fiedler(edges, rest.join(count, key, "left_semi"), key).join(count, key))
    return out.unionByName(fiedler(edges, rest, key).join(count, key, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))))


def snap(values: DataFrame, key: str) -> DataFrame:
    """Snap ranks and scores of (key, id, va, vb): the second vector is turned to point along the first, dv = vb - va."""
    dot = values.groupBy(key).agg(F.sum(F.col("va") * F.col("vb")).alias("_dot"))
    moved = values.join(dot, key).withColumn("vb", sign_align(F.col("va"), F.col("vb"), F.col("_dot"))).drop("_dot")
    return snap_ranks(moved.withColumn("dv", F.col("vb") - F.col("va")), [key])


def hinge(values: DataFrame, key: str) -> DataFrame:
    """(key, id) of the largest absolute va; the smallest id of equals."""
    return values.groupBy(key).agg(F.max_by("id", F.struct(F.abs("va"), -F.col("id"))).alias("id"))
