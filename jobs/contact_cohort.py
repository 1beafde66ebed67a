"""Batch job: contact graphs of many systems, waves through them, and how arrival goes with displacement.

Reads a table of points with two conformers each. For every system: the contacts of the first conformer (a radius
graph), a breadth-first wave from the node with most contacts, each node's displacement between the conformers, and
the rank correlation of arrival and displacement with its verdict. Writes, below ``output``:

* ``contacts/system=.../``: src, dst, d2
* ``nodes/system=.../``: id, degree, frame (-1 where the wave doesn't come), disp
* ``report/system=.../`` (JSON): n_nodes, n_edges, seed, reached, max_frame, mean_disp, n, rho, verdict

A run replaces the partitions of the systems that it reads and leaves others as they are, so it can be run again after
a failure, for all systems or for some (``systems``), with the same result. Points whose id, system or coordinates are
missing or not finite are left out and told.

    python jobs/contact_cohort.py --input .../embeddings.parquet --output /data/cohort
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import below, command_line, counted, settings
from tessera.functions import squared_distance
from tessera.operators import align, evaluate, graph, stats, traverse
from tessera.operators import contacts as near
from tessera.session import checkpoint

LOG = logging.getLogger("contact_cohort")
#: ``align``: none where conformers lie in one frame, kabsch to move the second onto the first, system by system.
DEFAULTS = {"input": None, "output": None, "format": "parquet", "id": "vec_id", "system": "label", "vector": "embedding", "first": 0, "second": 3, "scale": 10.0, "radius": 0.8, "align": "none", "systems": []}
AXES = ("x", "y", "z")
#: Contacts of a system, on average, from which they are written where they are made: a file for each task and system, but no exchange.
LARGE = 1_000_000


def points_of(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(system, id, x, y, z, qx, qy, qz) of the usable points, and one row with the numbers of all and of those."""
    rows = spark.read.format(config["format"]).load(config["input"])
    v = F.col(config["vector"])
    at = lambda start: [(config["scale"] * F.get(v, F.lit(start + i)).cast("double")) for i in range(3)]
    names = [*AXES, *align.Q]
    p = rows.select(F.col(config["system"]).alias("system"), F.col(config["id"]).alias("id"), *[c.alias(n) for c, n in zip(at(config["first"]) + at(config["second"]), names)])
    if config["systems"]:
        p = p.where(F.col("system").isin(config["systems"]))
    good = F.col("system").isNotNull() & F.col("id").isNotNull()
    for n in names:
        good = good & F.col(n).isNotNull() & (F.abs(F.col(n)) < F.lit(float("inf")))  # NaN is above it
    return p.where(good), p.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"))


def displaced(points: DataFrame, how: str) -> DataFrame:
    """(system, id, disp)."""
    pairs = points.select("system", "id", *[F.col(a).alias(f"p{a}") for a in AXES], *align.Q)
    if how == "kabsch":
        return align.displacements(align.apply_transform(pairs, align.kabsch(pairs, ["system"]), ["system"])).select("system", "id", "disp")
    if how != "none":
        raise ValueError(f"align is {how!r}; none or kabsch is needed")
    return pairs.select("system", "id", F.sqrt(squared_distance([F.col(c) for c in align.P], [F.col(c) for c in align.Q])).alias("disp"))


def _write(df: DataFrame, path: str, keys: list[str], kind: str = "parquet", stay: bool = False) -> int:
    """Replace the systems' partitions; a system that holds most rows is cut into ranges of ``keys``, unless rows are to ``stay``."""
    rows, seen = counted(df if stay else df.repartitionByRange(*keys))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").format(kind).save(path)
    n = seen.get["n"]
    LOG.info("wrote %d rows to %s", n, path)
    return n


def _read(spark: SparkSession, df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """What was written, with the types that it was written with."""
    return spark.read.format(kind).schema(df.schema).load(path)


def run(spark: SparkSession, config: dict) -> DataFrame:
    """The job; returns the whole output, read back: a row for each node with its system's report."""
    c = settings(DEFAULTS, config)
    points, told = points_of(spark, c)
    n = told.first()
    LOG.info("read %d points of %s, %d left out", n.n, c["input"], n.n - n.good)
    systems = points.select("system").distinct()

    # of large systems degrees and frames come from the points, so contacts are made once, to be written, and never read or moved
    degree = checkpoint(near.degrees(points, c["radius"], ["system"]).where("degree > 0"))
    size = degree.groupBy("system").agg(F.sum("degree").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("systems")).first()
    contacts = graph.radius_edges(points, c["radius"], ["system"]).select("system", "src", "dst", "d2")
    _write(contacts, below(c["output"], "contacts"), ["system", "src", "dst"], stay=(size.n or 0) > LARGE * size.systems)

    seeds = degree.groupBy("system").agg(F.min_by("id", F.struct(-F.col("degree"), "id")).alias("seed"))
    if (size.most or 0) <= traverse.KERNEL_EDGES:
        # partitions of systems that this run doesn't read are not its own
        edges = _read(spark, contacts, below(c["output"], "contacts")).join(systems, "system", "left_semi")
        frames = traverse.bfs_by_key(edges.select("system", "src", "dst"), seeds, ["system"], symmetric=True, plan="kernel").select("system", "id", "frame")
    else:
        frames = near.bfs(points, seeds, c["radius"], ["system"]).select("system", "id", "frame")
    nodes = points.select("system", "id").join(degree, ["system", "id"], "left").join(frames, ["system", "id"], "left").join(displaced(points, c["align"]), ["system", "id"])
    nodes = nodes.select("system", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("frame", F.lit(-1)).alias("frame"), F.round("disp", 6).alias("disp"))
    _write(nodes, below(c["output"], "nodes"), ["system", "id"])
    nodes = _read(spark, nodes, below(c["output"], "nodes"))

    own = nodes.join(systems, "system", "left_semi")
    reached = own.where("frame >= 0")
    sums = own.groupBy("system").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("n_edges"), F.round(F.avg("disp"), 6).alias("mean_disp"))
    arrived = reached.groupBy("system").agg(F.min_by("id", F.struct("frame", "id")).alias("seed"), F.count(F.lit(1)).alias("reached"), F.max("frame").alias("max_frame"))
    rho = stats.spearman(reached, "frame", "disp", ["system"])
    report = sums.join(arrived, "system", "left").join(rho, "system", "left")
    report = report.select(
        "system", "n_nodes", "n_edges", "seed", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("max_frame", F.lit(-1)).alias("max_frame"), "mean_disp",
        F.coalesce("n", F.lit(0)).alias("n"), F.round("rho", 6).alias("rho"), evaluate.correlation_verdict(F.round("rho", 6)).alias("verdict"),
    )
    _write(report, below(c["output"], "report"), ["system"], "json")
    told = _read(spark, report, below(c["output"], "report"), "json")
    return nodes.join(told, "system").select("system", "id", "degree", "frame", "disp", *[x for x in report.columns if x != "system"])


if __name__ == "__main__":
    command_line("contact_cohort", __doc__.splitlines()[0], DEFAULTS, run)
