"""The Fiedler pair of one system that no task holds: Lanczos on a filtered Laplacian, as DataFrame plans.

The edges are written once, in buckets by source, with a loop at each node that carries the diagonal. A product
with the Laplacian is a join of the vector with those buckets and a partially aggregated sum by target; a hub's edges
are spread over salts. Each step applies a Chebyshev polynomial of the Laplacian (as many products in one plan), which
is large below a cut and within [-1, 1] above it. Vectors are columns of one table by node; dot products
are one row. Only the small projected matrix, of ``steps`` rows, is on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.graph import symmetrize
from tessera.operators.traverse import _bucketed, _forget
from tessera.session import remove, saved, stored

SCHEMA = "id long, v double, eigenvalue double, n_components int, status string, reason string"
#: Salts of a hub's edges, and of a component's mean, which all of its nodes read.
SALTS = 16
#: A hub has more edges than this and more than one in a thousand of all, so that there are at most a thousand.
HUB_EDGES = 100_000


class Products:
    """Products with D - A of the edges (src, dst), both ways and once each, and a row (id, deg) for each node.

    Without hubs a vector that a product gave is already where the next one needs it, and each product moves rows once.
    """

    def __init__(self, pairs: DataFrame, nodes: DataFrame, hub: float):
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = pairs.select(F.col("src").alias("id"), "dst").unionByName(nodes.select("id", F.col("id").alias("dst")))
        hubs = saved(nodes.where(F.col("deg") > hub).select("id", F.lit(SALTS).alias("salts")), "hubs")
        self.hubs, self.by = (None, ["id"]) if hubs.isEmpty() else (hubs, ["id", "salt"])
        if self.hubs is not None:
            salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.lit(SALTS))).cast("int")
            edges = edges.join(F.broadcast(hubs), "id", "left").select("id", "dst", salt.alias("salt"))
        self.edges, *self._at = _bucketed(edges, self.by, n, "laplacian")

    def close(self) -> None:
        _forget(self.edges.sparkSession, *self._at)

    def once(self, rows: DataFrame) -> DataFrame:
        """(id, t, s, deg) to (id, a, t, s, deg) with a = (D - A) t."""
        if self.hubs is not None:
            rows = rows.join(F.broadcast(self.hubs), "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        near = rows.hint("shuffle_hash").join(self.edges, self.by)
        own = F.col("id") == F.col("dst")
        kept = [F.sum(F.when(own, F.col(c))).alias(c) for c in ("t", "s", "deg")]
        return near.groupBy(F.col("dst").alias("_id")).agg(F.sum(F.when(own, F.col("deg") * F.col("t")).otherwise(-F.col("t"))).alias("a"), *kept).withColumnRenamed("_id", "id")

    def chebyshev(self, rows: DataFrame, cut: float, top: float, degree: int) -> DataFrame:
        """(id, t, deg) to (id, y): T_degree of the map that takes [cut, top] to [1, -1], applied to t."""
        mid, half = (cut + top) / 2, (top - cut) / 2
        rows = rows.withColumn("s", F.lit(0.0))
        for i in range(degree):
            x = (F.lit(mid) * F.col("t") - F.col("a")) / F.lit(half)
            rows = self.once(rows).select("id", (x if i == 0 else 2 * x - F.col("s")).alias("_t"), F.col("t").alias("s"), "deg").withColumnRenamed("_t", "t")
        return rows.select("id", F.col("t").alias("y"))


def centred(rows: DataFrame, column: str, one: bool) -> DataFrame:
    """``column`` less its mean over the component; ``rows`` is read twice."""
    if one:
        return rows.withColumn(column, F.col(column) - F.lit(rows.agg(F.avg(column)).first()[0]))
    means = rows.groupBy("part").agg(F.avg(column).alias("_m")).withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_z", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(means, ["part", "_z"]).withColumn(column, F.col(column) - F.col("_m")).drop("_m", "_z")


def _mix(weights) -> F.Column:
    """The sum of the columns of ``q`` by ``weights``."""
    out = F.lit(0.0)
    for j, w in enumerate(weights):
        out = out + F.lit(float(w)) * F.col("q")[j]
    return out


class Basis:
    """Orthonormal columns ``q`` of one table (id, part, deg, q), and the filter's matrix between them."""

    def __init__(self, products: Products, start: DataFrame, one: bool, top: float):
        self.products, self.one, self.top = products, one, top
        self.table = self.path = None
        self._hold(start)

    def _hold(self, rows: DataFrame) -> None:
        new, path = stored(rows, "lanczos")
        self.close()
        self.table, self.path = new, path

    def close(self) -> None:
        if self.path:
            remove(self.table.sparkSession, self.path)

    def run(self, cut: float, degree: int, matrix: np.ndarray, steps: int, close: float) -> tuple[np.ndarray, np.ndarray, bool, float]:
        """Add columns until there are ``steps`` or the best pair is settled: (values, vectors, last norm is 0, estimate)."""
        m = matrix.shape[0] + 1
        while True:
            state = self.table
            y = self.products.chebyshev(state.select("id", F.col("q")[m - 1].alias("t"), "deg"), cut, self.top, degree)
            self._hold(state.join(y, "id"))
            if not self.one:
                self._hold(centred(self.table, "y", False))
            first = self.table.agg(*[F.sum(F.col("q")[j] * F.col("y")) for j in range(m)], F.sum(F.col("y") * F.col("y")), F.avg("y")).first()
            h = np.array(first[:m])
            rest = F.col("y") - F.lit(first[m + 1] if self.one else 0.0) - _mix(h)
            second = self.table.agg(*[F.sum(F.col("q")[j] * rest) for j in range(m)], F.sum(rest * rest)).first()
            g = np.array(second[:m])
            norm = np.sqrt(max(second[m] - g @ g, 0.0))
            matrix = np.pad(matrix, (0, 1))
            matrix[:, -1] = matrix[-1] = h + g
            values, vectors = np.linalg.eigh(matrix)
            values, vectors = values[::-1], vectors[:, ::-1]
            ended = norm <= 1e-12 * np.sqrt(first[m])
            estimate = norm * abs(vectors[-1, 0])
            if not ended:
                self.table = self.table.select("id", "part", "deg", F.array_append("q", (rest - _mix(g)) / F.lit(float(norm))).alias("q"))
            if ended or m == steps or estimate <= close * abs(values[0]):
                return values, vectors, ended, estimate
            m += 1

    def restart(self, vectors: np.ndarray, last: bool) -> None:
        """Keep the columns' mixtures by ``vectors``, and with ``last`` the newest column."""
        keep = [_mix(v) for v in vectors.T] + ([F.col("q")[vectors.shape[0]]] if last else [])
        self._hold(self.table.select("id", "part", "deg", F.array(*keep).alias("q")))


def fiedler_large(edges: DataFrame, nodes: DataFrame, steps: int = 24, degree: int = 8, restarts: int = 30, close: float = 1e-8) -> DataFrame:
    """(id, v, eigenvalue, n_components, status, reason) of the smallest eigenvalue of D - A above 0 and its vector.

    ``edges`` (src, dst) are taken both ways and once, without loops; ``nodes`` (id) may lack those of edges. The first entry by id
    above 1e-9 in size is positive. The pair belongs to one of the components; v is 0 in the others. One row with
    PIPELINE_FAILURE where there is no edge, or where the residual is above ``close`` times the larger of
    the eigenvalue and 1e-4 after ``restarts`` rounds; no row without a node.
    """
    spark = edges.sparkSession
    pairs = saved(symmetrize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")), "pairs")
    degrees = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    parts = connected_components(pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("component", "part")
    ids = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").unionByName(pairs.select(F.col("src").alias("id"))).distinct()
    base = saved(ids.join(parts, "id", "left").join(degrees, "id", "left").select("id", F.coalesce("part", "id").alias("part"), F.coalesce("deg", F.lit(0.0)).alias("deg")), "nodes")
    told = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == F.col("part")).alias("parts"), F.count_if((F.col("id") == F.col("part")) & (F.col("deg") > 0)).alias("joined"), F.max("deg").alias("most"), F.sum("deg").alias("entries")).first()
    fail = lambda why: spark.createDataFrame([(None, None, None, None, "PIPELINE_FAILURE", why)], SCHEMA)
    if not told.n:
        return spark.createDataFrame([], SCHEMA)
    if not told.joined:
        return fail(f"{told.n} nodes without an edge; every vector belongs to 0")

    live, one, top = base.where("deg > 0"), told.joined == 1, 2.0 * told.most
    products, basis = Products(pairs, live, max(HUB_EDGES, told.entries / 1000)), None
    try:
        draw = saved(live.withColumn("x", F.xxhash64("id", F.lit(7)) / F.lit(2.0**63)), "draw")
        drawn = saved(centred(draw, "x", one), "draw")
        size = drawn.agg(F.sum(F.col("x") * F.col("x"))).first()[0] ** 0.5
        basis = Basis(products, drawn.select("id", "part", "deg", F.array(F.col("x") / F.lit(size)).alias("q")), one, top)
        # plain steps first: their smallest value bounds the eigenvalue from above, and the filter's cut lies beyond it
        power, cut, matrix = 1, 0.0, np.zeros((0, 0))
        for _ in range(restarts):
            values, vectors, ended, estimate = basis.run(cut, power, matrix, steps if power > 1 else min(steps, 10), close / 100)
            if ended or estimate <= close / 100 * abs(values[0]):
                v = basis.table.select("id", "deg", _mix(vectors[:, 0]).alias("t"), F.lit(0.0).alias("s"))
                held, path = stored(products.once(v).select("id", "a", "t"), "pair")
                tt, ta = held.agg(F.sum(F.col("t") * F.col("t")), F.sum(F.col("t") * F.col("a"))).first()
                value = ta / tt
                off = held.agg(F.sum((F.col("a") - F.lit(value) * F.col("t")) ** 2)).first()[0] ** 0.5 / tt**0.5
                if off <= close * max(value, 1e-4):
                    sign = held.where(F.abs(F.col("t")) > 1e-9 * tt**0.5).agg(F.min_by("t", "id")).first()[0]
                    scale = (-1 if sign is not None and sign < 0 else 1) / tt**0.5
                    out = base.select("id").join(held, "id", "left").select("id", F.coalesce(F.col("t") * F.lit(scale), F.lit(0.0)).alias("v"))
                    out = saved(out.select("id", "v", F.lit(value).alias("eigenvalue"), F.lit(int(told.parts)).alias("n_components"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("reason")), "fiedler")
                    remove(spark, path)
                    return out
                remove(spark, path)
            mid, half = (cut + top) / 2, (top - cut) / 2
            bound = mid - half * np.cosh(np.arccosh(max(values[0], 1.0)) / power) if power > 1 else mid - half * values[0]
            wanted = max(4 * top / degree**2, 1.1 * bound)
            if power == 1 or wanted < cut / 2 or ended:
                power, cut = (degree, wanted) if wanted < 0.9 * top else (1, 0.0)
                basis.restart(vectors[:, :1], False)
                matrix = np.zeros((0, 0))
            else:
                few = min(8, len(values) - 1)
                basis.restart(vectors[:, :few], True)
                matrix = np.diag(values[:few])
        return fail(f"{told.n} nodes; Lanczos did not converge in {restarts} rounds")
    finally:
        products.close()
        if basis is not None:
            basis.close()
