"""Point tables: one representative per key, centroids, node numbers and seeds.

Points have ``id``, ``x``, ``y``, ``z`` and whatever else they carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import residue_code, squared_distance

XYZ = ("x", "y", "z")


def backbone_atoms(atoms: DataFrame, names: Sequence[str] = ("CA", "P", "C1'"), group: str | None = None) -> DataFrame:
    """Rows of the named atoms; with ``group`` only those records (ATOM, HETATM)."""
    out = atoms.where(F.col("atom").isin(*names))
    return out if group is None else out.where(F.col("group") == group)


def first_per_key(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row with the smallest ``position`` of each key, found by a partial aggregate rather than a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_r"))
    return best.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*rows.columns)


def last_per_key(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row with the largest ``position`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_r"))
    return best.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*rows.columns)


def select_atoms(atoms: DataFrame, least: int = 50) -> DataFrame:
    """The CA atoms of amino acids, or only where there are none the atoms CA, P and C1'; raises ValueError below ``least`` atoms."""
    chosen = backbone_atoms(atoms, ("CA",)).where(residue_code(F.col("residue")) != "X")
    if chosen.isEmpty():
        chosen = backbone_atoms(atoms)
    n = chosen.count()
    if n < least:
        raise ValueError(f"{n} atoms selected; {least} at least")
    return chosen


def representatives(atoms: DataFrame) -> DataFrame:
    """One point for each residue: its first atom in file order among CA, P and C1'."""
    keys = [c for c in ("file", "model", "chain", "subchain", "seq_id") if c in atoms.columns]
    return first_per_key(backbone_atoms(atoms), keys, "position")


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    """First CA of each residue with its one-letter code."""
    keys = [c for c in ("file", "model", "chain", "seq_id") if c in atoms.columns]
    return first_per_key(backbone_atoms(atoms, ("CA",)), keys, "position").withColumn("one_letter", residue_code(F.col("residue")))


def chain_or_first(points: DataFrame, chain: str, least: int = 30, position: str = "position") -> DataFrame:
    """Points of the named chain; else of the first chain with ``least`` points; else none."""
    sizes = points.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("at"))
    order = F.struct((F.col("chain") != chain).cast("int"), "at")
    pick = sizes.where((F.col("chain") == chain) | (F.col("n") >= least)).agg(F.min_by("chain", order).alias("chain"))
    return points.join(F.broadcast(pick), "chain", "left_semi")  # one row


def centroid(points: DataFrame, keys: Sequence[str] = (), axes: Sequence[str] = XYZ) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in axes])


def canonical_ids(points: DataFrame, order: Sequence[str | Column], name: str = "node") -> DataFrame:
    """Dense numbers from 0 in the given order.

    The order is made by Spark's range partitioner and sort; each partition numbers its own rows and adds
    the rows before it, so no single task sees all of them.
    """
    from tessera.session import checkpoint

    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = checkpoint(points.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_p": F.spark_partition_id(), "_r": F.monotonically_increasing_id()}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("_s")).select("_p", "_s", before.alias("_b"))  # a row for each partition
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_b") + F.col("_r") - F.col("_s")).cast("long")).drop("_p", "_r", "_s", "_b")


def nearest_to_centroid(points: DataFrame, axes: Sequence[str] = XYZ) -> DataFrame:
    """(id, d2) of the point nearest to the mean of all; the smallest id of equals."""
    c = F.broadcast(centroid(points, axes=axes))  # one row
    d2 = squared_distance([F.col(a) for a in axes], [F.col(f"c{a}") for a in axes])
    return points.join(c).select("id", d2.alias("d2")).agg(F.min_by("id", F.struct("d2", "id")).alias("id"), F.min("d2").alias("d2"))


def nearest_group(points: DataFrame, group: str, anchor: DataFrame) -> DataFrame:
    """The group whose centroid is nearest to the one-row ``anchor`` (ax, ay, az); the first name of equals."""
    c = centroid(points, [group]).join(F.broadcast(anchor))
    d2 = squared_distance([F.col(f"c{a}") for a in XYZ], [F.col(f"a{a}") for a in XYZ])
    return c.select(group, d2.alias("d2")).agg(F.min_by(group, F.struct("d2", group)).alias(group), F.min("d2").alias("d2"))


def seed_by_state(nodes: DataFrame) -> DataFrame:
    """First node with state 1, else first with an edge. ``nodes``: id, state, degree. No row if there is none."""
    ok = nodes.where((F.col("state") == 1) | (F.col("degree") > 0))
    return ok.agg(F.min_by("id", F.struct((F.col("state") != 1).cast("int"), "id")).alias("id")).where("id is not null")


def seed_cascade(points: DataFrame, group: str, preferred: int, others: Sequence[int]) -> DataFrame:
    """The residue ``preferred`` of the group; else the first of ``others`` in node order; else the point nearest to the group's centroid."""
    own = points.where(F.col("subchain") == group)
    c = F.broadcast(centroid(own))
    d2 = squared_distance([F.col(a) for a in XYZ], [F.col(f"c{a}") for a in XYZ])
    rank = F.when(F.col("seq_id") == preferred, 0).when(F.col("seq_id").isin(*others), 1).otherwise(2)
    key = F.struct(rank, F.when(rank == 2, d2).otherwise(0.0), "id")
    return own.join(c).agg(F.min_by("id", key).alias("id"))


def seed_high_degree(degrees: DataFrame, q: float = 0.99) -> DataFrame:
    """Smallest id with a degree at or above the interpolated ``q`` quantile; 0 if there is none."""
    from tessera.operators.stats import quantiles

    cut = F.broadcast(quantiles(degrees, "degree", {"cut": q}))  # one row
    return degrees.join(cut).where(F.col("degree") >= F.col("cut")).agg(F.coalesce(F.min("id"), F.lit(0)).alias("id"))


def seed_largest(values: DataFrame, value: str = "v") -> DataFrame:
    """Id of the largest absolute value, the smallest id of equals."""
    return values.agg(F.max_by("id", F.struct(F.abs(F.col(value)), -F.col("id"))).alias("id"))


def find_residue(points: DataFrame, chain: str, seq_id: int, code: str, position: str = "position") -> DataFrame:
    """First point at (chain, seq_id); no row if its code isn't ``code``, even where a later one has it."""
    first = points.where((F.col("chain") == chain) & (F.col("seq_id") == seq_id)).orderBy(position).limit(1)
    return first.where(F.col("one_letter") == code)
