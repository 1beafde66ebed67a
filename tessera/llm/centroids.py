"""Centroid clustering (Lloyd's rounds) in whole numbers over distinct vectors with multiplicities.

Vectors are quantised to whole numbers, equal ones become one row with a weight, and each round reads those rows only:
a task assigns its vectors and adds up weight times component by cluster, Spark adds the tasks' sums, and the driver
divides ``n_clusters`` rows. Whole numbers make every sum, and so every round, independent of order and partitioning.
At the end the assignments are joined back to the vectors' names. A vector that holds more than a thousandth of the
rows is sent to the rows (a thousand such vectors at most); the others meet in a join whose keys are all smaller.

Vectors that are null, have another number of components, or a component that is null or not finite, are left out.
Quantised components must lie within 2^27, so that squared distances fit 64 bits; beyond that an error is raised.
Ties go to the smaller cluster; repeated rows are rows of their own; a null ``vec_id`` counts as the empty text in the
seeding and stays null; with fewer vectors than clusters there are fewer clusters; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import saved

#: Largest quantised component.
MOST = 1 << 27
#: Below this size of components 64-bit floats hold all sums of a distance exactly, and matrix products are fast.
EXACT = 1 << 22
#: A vector with more than one in so many rows is heavy; so there are at most so many heavy vectors.
HEAVY = 1000
#: Vectors that a task holds as arrays at a time.
CHUNK = 8192


def quantised(vectors: DataFrame, size: int = 64, scale: int = 64, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, q): floor(scale * component) of the vectors with ``size`` finite components."""
    v = F.col("_v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    part = lambda x: F.floor(F.lit(float(scale)) * x)
    fits = F.when(F.abs(F.lit(float(scale)) * F.col("_m")) < float(MOST), F.transform(v, lambda x: part(x).cast("int"))).otherwise(F.raise_error(F.lit("a component lies beyond 2^27 after quantisation")).cast("array<int>"))
    kept = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].cast("array<double>").alias("_v")).where(v.isNotNull() & (F.size(v) == size) & whole)
    return kept.withColumn("_m", F.array_max(F.transform(v, lambda x: F.abs(x)))).select("vec_id", fits.alias("q"))


def seeds(points: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The vectors whose ``seed:vec_id`` has the smallest digests, in that order; equal digests by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.q) for r in points.select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller) and its squared distance, exactly."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    a, c = q.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (a @ c.T)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best].astype(np.int64)


def _chunks(batches, column: str = "q"):
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            part = b.slice(lo, CHUNK)
            q = part.column(part.schema.get_field_index(column))
            yield part, np.asarray(q.flatten()).reshape(part.num_rows, -1)


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor of the weighted mean of their vectors, unchanged where they have none."""
    import pyarrow as pa

    held = np.array(centroids, np.int64)
    k, size = held.shape
    names = [f"s{i}" for i in range(size)]

    def add(batches):
        # sums stay whole numbers of any size until they are handed on as text of decimals
        sums, weights = np.zeros((k, size), object), np.zeros(k, object)
        for part, q in _chunks(batches):
            w = np.asarray(part.column(part.schema.get_field_index("weight")))
            best, _ = nearest(q, held)
            fits = int(w.sum()) * int(np.abs(q).max(initial=0)) < 1 << 62
            for c in np.unique(best):
                own = best == c
                weights[c] += int(w[own].sum())
                sums[c] += (w[own][:, None] * q[own].astype(np.int64)).sum(0).astype(object) if fits else (w[own][:, None].astype(object) * q[own].astype(object)).sum(0)
        at = [c for c in range(k) if weights[c]]
        if at:
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array([str(weights[c]) for c in at]), *[pa.array([str(sums[c][i]) for c in at]) for i in range(size)]], names=["cluster", "n", *names])

    parts = distinct.mapInArrow(add, "cluster int, n string, " + ", ".join(f"{n} string" for n in names))
    rows = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]).collect()  # one row a cluster
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster] = [int(r[c]) // int(r.n) for c in names]
    return out


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster and distance to rows with q."""
    import pyarrow as pa

    held = np.array(centroids, np.int64)

    def run(batches):
        for part, q in _chunks(batches):
            best, d = nearest(q, held)
            yield pa.record_batch([*part.columns, pa.array(best.astype(np.int32)), pa.array(d)], names=[*part.schema.names, "cluster", "distance"])

    return distinct.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in distinct.dtypes) + ", cluster int, distance long")


def distinct_vectors(points: DataFrame) -> DataFrame:
    """(q, weight): equal vectors as one row; they are counted where they are before they meet."""
    return points.groupBy("q").agg(F.count(F.lit(1)).alias("weight"))


def joined_back(points: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Each of the ``n`` points with what ``found`` (q, weight and more) says of its vector.

    Heavy vectors, a thousand at most, go to the points; no key of the other join holds more than a thousandth of them.
    """
    heavy = F.col("weight") * HEAVY > n
    many = F.broadcast(found.where(heavy).withColumn("_heavy", F.lit(True)))
    far = points.join(many, "q", "left")
    at_once = far.where(F.col("_heavy").isNotNull()).drop("_heavy")
    rest = far.where(F.col("_heavy").isNull()).select("vec_id", "q").join(found.where(~heavy), "q")
    return at_once.unionByName(rest)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and copies (equal vectors) of every kept row."""
    spark = vectors.sparkSession
    points = quantised(vectors, size, scale, vector, vec_id)
    centroids = seeds(points, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id " + points.schema["vec_id"].dataType.simpleString() + ", cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, copies long")
    distinct = saved(distinct_vectors(points), "vectors")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    found = saved(assigned(distinct, centroids), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight"))
    own = {r.cluster: r for r in found.groupBy("cluster").agg(total.alias("d"), F.sum("weight").alias("n")).collect()}  # one row a cluster
    whole, n = sum(int(r.d) for r in own.values()), sum(r.n for r in own.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame(pd.DataFrame({"cluster": list(own), "cluster_inertia": [int(r.d) for r in own.values()], "inertia": [whole] * len(own), "centroid_sha256": [digest[c] for c in own]}), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = joined_back(points, found, n).join(F.broadcast(told), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("weight").alias("copies"))
