"""Exact percentiles, correlation with p-values, group summaries and contributors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Distinct values whose ranks are sent to every task.
BROADCAST_VALUES = 200_000
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def given(column: str | Column) -> Column:
    """The value, or null where it is NaN: no statistic counts either, and Spark would order NaN above all numbers."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c.cast("double")), c)


def quantiles(rows: DataFrame, value: str, at: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a column for each name of ``at``): exact quantiles, interpolated; nulls and NaN are left out.

    Counts of distinct values are cut into ranges by Spark's range partitioner; the counts before each range
    tell which values stand at the wanted ranks. No task holds all values of a key, whatever its share.
    """
    from tessera.session import checkpoint

    keys = list(keys)
    counts = rows.select(*keys, given(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranged = checkpoint(counts.repartitionByRange(*[F.col(k) for k in keys], F.col("_v")).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))  # a row for each range, and for each key
    whole = Window.partitionBy(*keys)
    starts = sums.select(*keys, "_p", (F.sum("_s").over(whole.orderBy("_p")) - F.col("_s")).alias("_b"), F.sum("_s").over(whole).alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    l, r = ranged.withColumn("_u", upto).alias("l"), starts.alias("r")
    on = [*[F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.col("l._p") == F.col("r._p")]
    placed = l.join(r, on).select(*[F.col(f"l.{k}").alias(k) for k in keys], "_v", "_n", (F.col("_b") + F.col("_u") - F.col("_c")).alias("_lo"), (F.col("_b") + F.col("_u")).alias("_hi"))
    picks = []
    for name, q in at.items():
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        for side, place in (("l", F.floor(rank)), ("r", F.ceil(rank))):
            picks.append(F.max(F.when((F.col("_lo") <= place) & (place < F.col("_hi")), F.col("_v"))).alias(f"_{side}_{name}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_w_{name}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[(F.col(f"_l_{n}") + (F.col(f"_r_{n}") - F.col(f"_l_{n}")) * F.col(f"_w_{n}")).alias(n) for n in at])


def describe(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, p90, p95, p99 (interpolated) and max; nulls and NaN are left out."""
    keys, v = list(keys), given(value)
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    q = quantiles(rows, value, QUANTILES, keys)
    names = ["n", "mean", *QUANTILES, "max"]
    if not keys:
        return out.join(F.broadcast(q)).select(*names)  # one row each
    a, b = out.alias("a"), q.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], *names)


def pearson(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """n and r over rows with both values; nulls and NaN are left out; null where one side is constant."""
    both = rows.where(given(x).isNotNull() & given(y).isNotNull())
    # corr() itself divides by zero where a side is constant
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias("r"))


def _ranks(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the mean rank to counts (keys, _v, _p, _c), _p being ranges in the order of keys and _v.

    A value may stand in several ranges, one after the other. Only a row for each range (and key) passes through one task.
    """
    sums = counts.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_s").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "_p", before.alias("_b"))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    l, r = counts.withColumn("_w", within).alias("l"), starts.alias("r")
    joined = l.join(r, [*[F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.col("l._p") == F.col("r._p")])
    placed = joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], "_v", F.col("l._p").alias("_p"), "_c", (F.col("_b") + F.col("_w")).alias("_b"))
    one = Window.partitionBy(*keys, "_v")  # as many rows as ranges hold the value
    return placed.withColumn(name, F.min("_b").over(one) + (F.sum("_c").over(one) + 1) / 2).drop("_b", "_c")


def average_rank(rows: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the rank from 1, ties sharing their mean rank; null where the value is null or NaN, which aren't ranked.

    Ranks come from counts of the distinct values. Where those are few they are sent to the rows. Else the rows are cut into
    ranges of the sorted values, which a value with many rows may fill several of, and meet their ranks by value and
    range: no key of that join has more rows than a range.
    """
    from tessera.session import checkpoint

    keys = list(keys)
    v = given(value)
    counts = checkpoint(rows.select(*keys, v.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    order = [*[F.col(k) for k in keys], F.col("_v")]
    few = counts.count() <= BROADCAST_VALUES
    if few:
        src = rows.withColumn("_v", v)
        ranks = F.broadcast(_ranks(checkpoint(counts.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())), keys, name).drop("_p"))
    else:
        src = checkpoint(rows.withColumns({"_v": v, "_t": F.monotonically_increasing_id()}).repartitionByRange(*order, F.col("_t")).withColumn("_p", F.spark_partition_id()))
        ranks = _ranks(src.where("_v is not null").groupBy(*keys, "_v", "_p").agg(F.count(F.lit(1)).alias("_c")), keys, name)
    a, b = src.alias("a"), ranks.alias("b")
    on = [*[F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in (["_v"] if few else ["_v", "_p"])]]
    return a.join(b, on, "left").select(*[f"a.`{c}`" for c in rows.columns], f"b.{name}")


def spearman(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """n and rho: Pearson's r of the average ranks of the rows with both values; nulls and NaN are left out."""
    both = rows.select(*keys, given(x).alias("_x"), given(y).alias("_y")).where("_x is not null and _y is not null")
    ranked = average_rank(average_rank(both, "_x", "_rx", keys), "_y", "_ry", keys)
    return pearson(ranked, "_rx", "_ry", keys).withColumnRenamed("r", "rho")


def t_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if r is None or r != r or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    nu = n - 2
    t2 = r * r * nu / (1 - r * r)
    return min(1.0, _regular(nu / 2, 0.5, nu / (nu + t2)))


def _regular(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta; the series converges on the side where x is small."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _regular(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def with_p_value(rows: DataFrame, r: str = "r") -> DataFrame:
    """Adds p to a table of few rows with n and r."""
    def add(batches):
        for b in batches:
            p = [t_p_value(x, n) for x, n in zip(b.column(b.schema.get_field_index(r)).to_pylist(), b.column(b.schema.get_field_index("n")).to_pylist())]
            yield pa.record_batch([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p"])

    return rows.mapInArrow(add, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", p double")


def group_summary(rows: DataFrame, key: str, frame: str, disp: str, least: int = 5, top: int = 15) -> DataFrame:
    """Per key n, median frame, median and mean value, for keys with ``least`` rows; the ``top`` by mean.

    Rows count that have both values; nulls and NaN are left out.
    """
    own = rows.select(key, given(frame).alias("_f"), given(disp).alias("_d")).where("_f is not null and _d is not null")
    out = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_disp")).where(F.col("n") >= least)
    for value, name in (("_f", "median_frame"), ("_d", "median_disp")):
        q = quantiles(own, value, {name: 0.5}, [key]).withColumnRenamed(key, "_k")
        out = out.join(q, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    return out.select(key, "n", "median_frame", "median_disp", "mean_disp").orderBy(F.desc("mean_disp"), key).limit(top)


def top_contributors(rows: DataFrame, value: str, keys: Sequence[str], q: float = 0.95, top: int = 15) -> DataFrame:
    """Groups with most rows at or above the ``q`` quantile of ``value``; nulls and NaN are left out."""
    cut = F.broadcast(quantiles(rows, value, {"_cut": q}))  # one row
    return rows.join(cut).where(given(value) >= F.col("_cut")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(top)


def top_movers(rows: DataFrame, value: str, tie: Sequence[str], top: int = 30) -> DataFrame:
    """The ``top`` rows by value; nulls and NaN are left out."""
    return rows.where(given(value).isNotNull()).orderBy(F.desc(value), *tie).limit(top)
