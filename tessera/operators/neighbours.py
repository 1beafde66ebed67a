"""Exact nearest neighbours of wide vectors by a metric index.

Equal vectors become one row with its smallest ids. Pivots, spread out by a farthest-first pass over a bounded sample, cut the
rows into cells: each row lies in the cell of its nearest pivot, which knows how near and how far its rows are. A first round
compares rows within their cell. What a row has found by then bounds how far its neighbours can be, and by the triangle
inequality most other cells can't hold one; a second round sends a row to the cells that can, and rows for which
there are none take no part in it. Both rounds meet in blocks of bounded size, whatever share of the rows a cell holds.

No table passes through the driver: it holds the sample, the pivots and a row for each cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import saved

#: Rows that a cell is to have; at most so many pivots, chosen among at most so many rows.
CELL_ROWS, MOST_PIVOTS, SAMPLE_ROWS = 2048, 4096, 16_384
#: Rows of either side that meet in one group of a task.
BLOCK_ROWS = 8192
#: An equal vector with more than one in so many points is sent to the points; so there are at most so many.
HEAVY = 1000
#: Rounding that bounds on distances allow for, as a share of the vectors' lengths.
SLACK = 1e-6
#: Rounding that a matrix product's squared distances allow for, as a share of the squared lengths.
ROUNDING = 1e-11
FOUND = "src long, dst long, d2 double"


@dataclass
class Work:
    """How many distances between rows were computed, of how many there are, and how many rows took part in each round."""

    compared: int
    pairs: int
    first: int
    second: int
    cells: int


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows (fewer if they are fewer): the first one, then again and again the one farthest from those taken."""
    taken, far = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(taken) < min(n, len(rows)):
        at = int(far.argmax())
        if far[at] == 0:
            break
        taken.append(at)
        far = np.minimum(far, ((rows - rows[at]) ** 2).sum(1))
    return rows[taken]


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots, and how far off they can be in each row."""
    xx, pp = (x * x).sum(1), (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(xx[:, None] + pp[None] - 2 * (x @ pivots.T), 0)), SLACK * (np.sqrt(xx) + np.sqrt(pp.max()))


def nearest(own: np.ndarray, src: np.ndarray, others: np.ndarray, vid: np.ndarray, ids: list[np.ndarray], k: int, limit: np.ndarray | None = None):
    """(src, dst, d2): each row's ``k`` best of the others' ids by (d2, id), its own vector left out, none beyond ``limit``.

    A matrix product finds who can be among the best, rounding allowed for; their squares are then added axis by axis, so a
    distance is the same wherever it is computed.
    """
    out = []
    count = np.array([len(i) for i in ids], np.int64)
    start, flat = np.cumsum(count) - count, np.concatenate(ids) if ids else np.empty(0, np.int64)
    bb = (others * others).sum(1)
    for lo in range(0, len(own), 256):
        a, name = own[lo : lo + 256], src[lo : lo + 256]
        aa = (a * a).sum(1)
        off = ROUNDING * (aa + bb.max())
        rough = aa[:, None] + bb[None] - 2 * (a @ others.T)
        rough[name[:, None] == vid[None]] = np.inf
        m = min(k, len(others))
        cut = np.partition(rough, m - 1, axis=1)[:, m - 1] + 2 * off
        if limit is not None:
            cut = np.minimum(cut, limit[lo : lo + 256] + off)
        i, j = np.nonzero((rough <= cut[:, None]) & np.isfinite(rough))
        d2 = np.zeros(len(i))
        for x in range(own.shape[1]):
            diff = a[i, x] - others[j, x]
            d2 += diff * diff
        n = count[j]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[j], n)
        i, d2, dst = np.repeat(i, n), np.repeat(d2, n), flat[at]
        order = np.lexsort((dst, d2, i))
        i, d2, dst = i[order], d2[order], dst[order]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        if limit is not None:
            ok &= d2 <= limit[lo : lo + 256][i]
        out.append((name[i[ok]], dst[ok], d2[ok]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def _meet(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Best (src, dst, d2) of each block of queries (vid, v, limit) in each block of rows (vid, v, ids); both have cell, qb, pb."""
    at = ["cell", "qb", "pb"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        lists = right["ids"].combine_chunks()
        flat, cut = np.asarray(lists.flatten(), np.int64), np.cumsum(np.asarray(lists.value_lengths()))[:-1]
        limit = np.asarray(left["limit"].combine_chunks(), np.float64)
        src, dst, d2 = nearest(_matrix(left["v"]), np.asarray(left["vid"].combine_chunks()), _matrix(right["v"]), np.asarray(right["vid"].combine_chunks()), np.split(flat, cut), k, limit)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d2": pa.array(d2, pa.float64())})

    # new names: both sides may come from one table
    l = queries.select(*[F.col(c).alias(c) for c in (*at, "vid", "v", "limit")])
    r = rows.select(*[F.col(c).alias(c) for c in (*at, "vid", "v", "ids")])
    return l.groupBy(*at).cogroup(r.groupBy(*at)).applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return found.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def _blocks(name: str, n: str):
    """Number of a row's block among so many."""
    return F.pmod(F.xxhash64(name, F.lit(17)), F.col(n)).cast("int")


def knn_metric(points: DataFrame, k: int, vector: str = "embedding") -> tuple[DataFrame, Work]:
    """Exact ``k`` nearest neighbours (src, dst, d2) of all points (id, vector), and the work that took.

    Ties go to the smaller id; a point is no neighbour of itself, told by id and not by distance. Points whose vector is
    null or has a null, NaN or infinite component are left out, and ValueError is raised where lengths differ.
    The work depends on the data: where distances differ little, as in uniform noise of many dimensions, no cell can be left
    out and it is that of all pairs.
    """
    spark = points.sparkSession
    v = F.col("v")
    p = points.select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    p = p.where(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))  # NaN is above it
    size = p.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi")).first()
    if not size.n or not size.hi:
        return spark.createDataFrame([], FOUND), Work(0, 0, 0, 0, 0)
    if size.lo != size.hi:
        raise ValueError(f"vectors of {size.lo} to {size.hi} components")
    # only the first ids of equal vectors are kept, and Spark cuts to those before rows move
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = saved(p.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("vid"), "v", "ids"), "distinct")
    m = distinct.count()
    n_pivots = max(1, min(MOST_PIVOTS, -(-m // CELL_ROWS)))
    some = distinct.select("vid", "v").orderBy(F.xxhash64("vid"), "vid").limit(min(SAMPLE_ROWS, 16 * n_pivots)).toArrow()
    pivots = farthest_first(_matrix(some["v"]), n_pivots)

    def place(batches):
        for b in batches:
            d, _ = _to_pivots(_matrix(b.column(1)), pivots)
            at = d.argmin(1)
            yield pa.record_batch([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=[*b.schema.names, "cell", "r"])

    placed = saved(distinct.mapInArrow(place, f"vid long, v {distinct.schema['v'].dataType.simpleString()}, ids array<bigint>, cell int, r double"), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # one row a pivot
    parts = F.broadcast(spark.createDataFrame([(c.cell, -(-c.n // BLOCK_ROWS)) for c in cells], "cell int, parts int"))

    blocked = placed.join(parts, "cell").withColumn("own", _blocks("vid", "parts"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = blocked.withColumn("pb", F.col("own"))
    best = saved(_best(_meet(blocked.withColumn("qb", F.col("own")).withColumn("pb", each).withColumn("limit", F.lit(float("inf"))), rows.withColumn("qb", each), k), k), "near")

    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for c in cells:
        low[c.cell], high[c.cell] = c.lo, c.hi

    def probe(batches):
        for b in batches:
            d, off = _to_pivots(_matrix(b.column(1)), pivots)
            tau = np.sqrt(np.asarray(b.column(3), np.float64))
            bound = np.maximum(d - high[None], low[None] - d) - 2 * off[:, None]
            reach = bound <= tau[:, None]
            reach[np.arange(len(d)), np.asarray(b.column(2))] = False
            reach[:, ~np.isfinite(low)] = False
            i, c = np.nonzero(reach)
            offsets = np.searchsorted(i, np.arange(len(d) + 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int32)))], names=["vid", "v", "limit", "cells"])

    tau = best.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.max("d2").alias("_d"))
    asked = placed.join(tau, F.col("vid") == F.col("src"), "left").select("vid", "v", "cell", F.when(F.col("_n") >= k, F.col("_d")).otherwise(float("inf")).alias("limit"))
    open_ = saved(asked.mapInArrow(probe, f"vid long, v {distinct.schema['v'].dataType.simpleString()}, limit double, cells array<int>").where(F.size("cells") > 0), "open")
    sent = open_.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a pivot
    own = {c.cell: c.n for c in cells}
    work = Work(sum(n * n for n in own.values()) + sum(s.n * own[s.cell] for s in sent), m * m, m, open_.count(), len(own))
    if sent:
        asks = F.broadcast(spark.createDataFrame([(s.cell, -(-s.n // BLOCK_ROWS)) for s in sent], "cell int, asks int"))
        queries = open_.select("vid", "v", "limit", F.explode("cells").alias("cell")).join(asks, "cell").join(parts, "cell").withColumn("qb", _blocks("vid", "asks")).withColumn("pb", each)
        second = _meet(queries, rows.join(asks, "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))), k)
        best = saved(_best(best.unionByName(second), k), "nearest")
    return _of_points(p, distinct, best, k, size.n), work


def _of_points(p: DataFrame, distinct: DataFrame, best: DataFrame, k: int, n: int) -> DataFrame:
    """Each point's neighbours: the other points of its vector and those of other vectors that it shares with them."""
    lists = best.groupBy("src").agg(F.collect_list(F.struct("d2", "dst")).alias("others"))  # k at most
    told = distinct.join(lists, F.col("vid") == F.col("src"), "left").select("v", "ids", F.coalesce("others", F.array().cast("array<struct<d2:double,dst:bigint>>")).alias("others"))
    # vectors with many points, HEAVY at most, are sent to the points; the others meet by vector
    heavy = F.broadcast(p.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HEAVY > n).select("v"))
    many, few = told.join(heavy, "v", "left_semi"), told.join(heavy, "v", "left_anti")
    both = p.join(F.broadcast(many), "v").unionByName(p.join(heavy, "v", "left_anti").join(few, "v"))
    same = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("dst")))
    near = F.slice(F.array_sort(F.concat(same, "others")), 1, k)
    return both.select(F.col("id").alias("src"), F.explode(near).alias("x")).select("src", "x.dst", "x.d2")
