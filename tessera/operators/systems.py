"""Whole runs over many systems at once: tubes against cylinders, and spectral comparison of two conformers.

A run is a plan keyed by system. A system that can't be run keeps one row with status PIPELINE_FAILURE and
the reason; the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import squared_distance
from tessera.operators import align, contacts, evaluate, points, spectral, stats
from tessera.session import checkpoint

FAILED = "PIPELINE_FAILURE"


def _status(rows: DataFrame, reason, kept: list[str], key: str) -> DataFrame:
    """Status and reason; the other columns of a failure are null."""
    out = rows.withColumn("reason", reason)
    out = out.withColumn("status", F.when(F.col("reason").isNull(), "OK").otherwise(FAILED))
    return out.select(key, "status", "reason", *[F.when(F.col("status") == "OK", F.col(c)).alias(c) for c in kept])


def run_systems(nodes: DataFrame, seeds: DataFrame, truth: DataFrame, radius: float = 8.0, slack: int = 1, window: int = 2) -> DataFrame:
    """Per system: status, reason, n, n_edges, length, m, precision, recall and F1 of tube and cylinder, and delta of the F1.

    ``nodes``: system, id, chain, seq_id, code, x, y, z. ``seeds``: system, and chain, seq_id and code of
    both seeds as chain_a and so on; the first node at the place counts, and only with that code.
    ``truth``: system, chain, seq_id.
    """
    key = ["system"]
    first = checkpoint(points.first_per_key(nodes.select("system", "chain", "seq_id", "id", "code"), ["system", "chain", "seq_id"], "id"))
    ends = seeds
    for s in "ab":
        at = first.select("system", F.col("chain").alias(f"chain_{s}"), F.col("seq_id").alias(f"seq_id_{s}"), F.col("id").alias(s), F.col("code").alias("_code"))
        ends = ends.join(at, ["system", f"chain_{s}", f"seq_id_{s}"], "left").withColumn(s, F.when(F.col("_code") == F.col(f"code_{s}"), F.col(s))).drop("_code")
    ends = checkpoint(ends.select("system", "a", "b"))
    known = ends.where("a is not null and b is not null")
    own = nodes.join(known, "system", "left_semi")
    # points move and pairs don't: near-complete graphs have too many edges for rows
    starts = known.select("system", F.explode(F.array("a", "b")).alias("seed"))
    frames = checkpoint(contacts.bfs(own, starts, radius, key)).join(known, "system")
    da = frames.where("seed = a").select("system", "a", "b", "id", F.col("frame").alias("d_a"))
    db = frames.where("seed = b").select("system", "id", F.col("frame").alias("d_b"))
    length = da.where("id = b").select("system", F.col("d_a").alias("length"))
    tube = checkpoint(da.join(db, ["system", "id"]).join(length, "system").where((F.col("d_a") + F.col("d_b") <= F.col("length") + slack) & (F.col("id") != F.col("a")) & (F.col("id") != F.col("b"))).select("system", "id"))
    size = tube.groupBy("system").agg(F.count(F.lit(1)).alias("m"))
    both = known
    for s in "ab":
        both = both.join(own.select("system", F.col("id").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]), ["system", s])
    cylinder = evaluate.cylinder(own, both, size, key)
    right = truth.join(size, "system", "left_semi").select("system", "chain", F.col("seq_id").alias("seq"))

    def scored(found: DataFrame, name: str) -> DataFrame:
        places = found.select("system", "id").join(own, ["system", "id"]).select("system", "chain", F.col("seq_id").alias("seq"))
        return evaluate.score(evaluate.windowed_hits(places, right, window, key)).select("system", *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")])

    counts = own.groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    entries = contacts.degrees(own, radius, key).groupBy("system").agg(F.sum("degree").alias("n_edges"))
    out = ends
    for part in (counts, entries, length, size, scored(tube, "tube"), scored(cylinder, "cylinder")):
        out = out.join(part, "system", "left")
    out = out.withColumn("delta", F.col("tube_f1") - F.col("cylinder_f1")).withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    # The words of the reasons.
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "seed not found or name mismatch").when(F.col("length").isNull(), "seed A and B in different components").when(F.col("m").isNull(), "empty tube")
    return _status(out, reason, ["n", "n_edges", "length", "m", *[f"{x}_{c}" for x in ("tube", "cylinder") for c in ("precision", "recall", "f1")], "delta"], "system")


PAIR = [
    "n", "n_edges_a", "n_edges_b", "n_components_a", "n_components_b", "lambda_a", "lambda_b", "hinge", "total_snap_count",
    "rho", "p", "rho_euclid", "p_euclid", "delta_rho", "tm_score", "rmsd",
]


def run_pairs(a: DataFrame, b: DataFrame, key: str, radius: float = 5.0, least: int = 20, window: int = 2) -> DataFrame:
    """Per pair of conformers: status, reason and the columns ``PAIR``.

    ``a``, ``b``: key, seq_id, x, y, z. Residues are matched in order within the window; the second graph comes
    from the aligned coordinates; mobility by snap rank and distance from the hinge are each correlated with
    the displacement. Nodes are numbered by the place of their match.
    """
    names = [key, "seq_id"]
    a, b = (points.last_per_key(x.select(*names, "x", "y", "z").withColumn("_at", F.col("seq_id")), names, "_at").drop("_at") for x in (a, b))
    sizes = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b")), key, "full")
    matched = align.window_match(a, b, key, "seq_id", window).withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("seq_a")) - 1)
    side = lambda x, s, n: x.select(key, F.col("seq_id").alias(s), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    pairs = checkpoint(matched.join(side(a, "seq_a", "p"), [key, "seq_a"]).join(side(b, "seq_b", "q"), [key, "seq_b"]).select(key, F.col("id").cast("long").alias("id"), *align.P, *align.Q))
    n = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    enough = sizes.join(n, key, "left").where((F.col("n_a") >= least) & (F.col("n_b") >= least) & (F.col("n") >= least)).select(key)
    pairs = pairs.join(enough, key, "left_semi")
    moved = checkpoint(align.displacements(align.apply_transform(pairs, align.kabsch(pairs, [key]), [key])))
    out, values, reasons = sizes.join(n, key, "left"), None, []
    for s, axes in (("a", align.P), ("b", ("ax", "ay", "az"))):
        nodes = moved.select(key, "id", *[F.col(c).alias(x) for c, x in zip(axes, "xyz")])
        solved = checkpoint(spectral.fiedler_of_points(nodes, radius, key))
        count = solved.groupBy(key).agg(F.first("n_edges").alias(f"n_edges_{s}"))
        told = solved.groupBy(key).agg(F.first("n_components").alias(f"n_components_{s}"), F.first("eigenvalue").alias(f"lambda_{s}"), F.max(F.when(F.col("status") != "OK", F.col("reason"))).alias(f"_why_{s}"))
        out = out.join(count, key, "left").join(told, key, "left")
        reasons.append(F.col(f"_why_{s}"))
        v = solved.where("status = 'OK'").select(key, "id", F.col("v").alias(f"v{s}"))
        values = v if values is None else values.join(v, [key, "id"])
    snapped = checkpoint(spectral.snap(values, key))
    seed = spectral.hinge(snapped, key).withColumnRenamed("id", "hinge")
    at = seed.join(moved.select(key, F.col("id").alias("hinge"), *[F.col(c).alias(f"h{c}") for c in align.P]), [key, "hinge"])
    far = F.sqrt(squared_distance([F.col(c) for c in align.P], [F.col(f"h{c}") for c in align.P]))
    rows = checkpoint(snapped.join(moved, [key, "id"]).join(at, key).select(key, "pms", "disp", "snap_rank", far.alias("euclid")))
    snaps = rows.groupBy(key).agg(F.count_if(F.col("snap_rank") > 0).alias("total_snap_count"))
    rank = lambda x, r, p: stats.with_p_value(stats.spearman(rows, x, "disp", [key]), "rho").select(key, F.col("rho").alias(r), F.col("p").alias(p))
    tm = align.tm_score(moved.join(n, key), "n", keys=[key])
    for part in (seed, snaps, rank("pms", "rho", "p"), rank("euclid", "rho_euclid", "p_euclid"), tm, align.rmsd(moved, [key]).select(key, "rmsd")):
        out = out.join(part, key, "left")
    out = out.withColumn("delta_rho", F.col("rho") - F.col("rho_euclid"))
    count = F.coalesce("n", F.lit(0))
    few = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) < least
    empty = F.col("n_edges_a").isNull() | F.col("n_edges_b").isNull()
    # The words of the reasons.
    reason = F.when(few, "too few atoms").when(count < least, F.concat(F.lit("only "), count.cast("string"), F.lit(" matched residues")))
    reason = F.coalesce(reason, *reasons, F.when(empty, f"empty graph at {radius:g}"))
    return _status(out, reason, PAIR, key)
