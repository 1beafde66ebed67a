"""Scoring of predicted node sets: cylinders, windowed matches, precision and recall, cohorts, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import segment_distance
from tessera.operators import stats

XYZ = ("x", "y", "z")


def cylinder(points: DataFrame, ends: DataFrame, m: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, dist): the m points nearest to the segment between two ends, which are left out; ties by id.

    ``ends``: keys, a, b and the coordinates ax..az, bx..bz; ``m``: keys, m. Without keys both are one
    row, m is read and the choice is a global top-m, which every partition makes for itself before
    the best of all are merged; with keys a rank within each key.
    """
    if not keys:
        most = m.first()
        most = int(most.m) if most is not None and most.m is not None else 0
    one = ends.join(m, list(keys)) if keys else ends
    p = points.join(one, list(keys)) if keys else points.join(F.broadcast(one))
    dist = segment_distance(*[[F.col(f"{s}{a}") for a in XYZ] for s in ("", "a", "b")])
    p = p.where((F.col("id") != F.col("a")) & (F.col("id") != F.col("b"))).withColumn("dist", dist)
    if not keys:
        return p.select("id", "dist").orderBy("dist", "id").limit(most)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "id"))
    return p.withColumn("_n", rank).where(F.col("_n") <= F.col("m")).select(*keys, "id", "dist")


def ends_of(points: DataFrame, a: int, b: int) -> DataFrame:
    """One row with both ends' ids and coordinates."""
    pick = lambda i, s: points.where(F.col("id") == i).select(F.col("id").alias(s), *[F.col(c).alias(f"{s}{c}") for c in XYZ])
    return pick(a, "a").join(F.broadcast(pick(b, "b")))


def windowed_hits(pred: DataFrame, truth: DataFrame, window: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """One row (a key): n_pred, n_truth, pred_hits and truth_hits.

    A prediction hits where a true position of its chain is at most ``window`` away, and the other way
    round. Both directions are equi-joins on (chain, position) after one side is widened.
    """
    cols = [*keys, "chain", "seq"]
    p, t = pred.select(*cols).distinct(), truth.select(*cols).distinct()
    wide = lambda d: d.withColumn("seq", F.explode(F.sequence(F.col("seq") - window, F.col("seq") + window))).distinct()
    hit = lambda x, y, n: x.join(wide(y), cols, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    size = lambda x, n: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = None
    for part in (size(p, "n_pred"), size(t, "n_truth"), hit(p, t, "pred_hits"), hit(t, p, "truth_hits")):
        out = part if out is None else out.join(part, list(keys), "full") if keys else out.join(F.broadcast(part))
    return out.na.fill(0, ["n_pred", "n_truth", "pred_hits", "truth_hits"])


def precision_recall_f1(n_pred: Column, n_truth: Column, pred_hits: Column, truth_hits: Column) -> list[Column]:
    """precision, recall, f1: all 1 if both sets are empty, all 0 if one is."""
    none, one = (n_pred == 0) & (n_truth == 0), (n_pred == 0) | (n_truth == 0)
    p, r = pred_hits / F.nullif(n_pred, F.lit(0)), truth_hits / F.nullif(n_truth, F.lit(0))
    f = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    return [F.when(none, 1.0).when(one, 0.0).otherwise(x).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f))]


def score(hits: DataFrame) -> DataFrame:
    return hits.select("*", *precision_recall_f1(*[F.col(c) for c in ("n_pred", "n_truth", "pred_hits", "truth_hits")]))


def partition_sets(a: DataFrame, b: DataFrame, names: Sequence[str] = ("A_ONLY", "B_ONLY", "BOTH")) -> DataFrame:
    """(id, part) of the union of two id sets."""
    x, y = a.select("id").distinct().withColumn("_a", F.lit(1)), b.select("id").distinct().withColumn("_b", F.lit(1))
    return x.join(y, "id", "full").select("id", F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise(names[2]).alias("part"))


def cohort(rows: DataFrame, delta: str = "delta") -> DataFrame:
    """n, median of the differences, wins (above 0; ties count as losses), losses, win_pct and the verdict.

    Nulls and NaN are no cases.
    """
    d = stats.given(delta)
    out = rows.agg(F.count(d).alias("n"), F.count_if(d > 0).alias("wins")).join(F.broadcast(stats.quantiles(rows, delta, {"median_delta": 0.5})))  # one row each
    out = out.select("n", "median_delta", "wins").withColumns({"losses": F.col("n") - F.col("wins"), "win_pct": 100.0 * F.col("wins") / F.nullif(F.col("n"), F.lit(0))})
    return out.withColumn("verdict", verdict(F.col("median_delta"), F.col("win_pct")))


# The words and bars of both ladders.


def verdict(median: Column, win_pct: Column, establish: float = 0.05, win: float = 70.0, reject: float = 0.01, lose: float = 50.0) -> Column:
    """ESTABLISH from both bars on; REJECT at or below the lower bar or with half the cases lost; else INCONCLUSIVE.

    Null where either figure is null or NaN.
    """
    m, w = stats.given(median), stats.given(win_pct)
    ladder = F.when((m >= establish) & (w >= win), "ESTABLISH").when((m <= reject) | (100.0 - w >= lose), "REJECT").otherwise("INCONCLUSIVE")
    return F.when(m.isNotNull() & w.isNotNull(), ladder)


def correlation_verdict(rho: Column, signal: float = 0.3, weak: float = 0.15) -> Column:
    """SIGNAL, WEAK SIGNAL or NO SIGNAL by the size of a correlation; null where it is null or NaN."""
    size = F.abs(stats.given(rho))
    return F.when(size >= signal, "SIGNAL").when(size >= weak, "WEAK SIGNAL").when(size < weak, "NO SIGNAL")


def pair_cohort(rows: DataFrame, least: int = 5) -> DataFrame:
    """One row of a cohort of pair runs: n, median rho, wins (delta_rho above 0), win_pct, and the rank correlation of snaps with 1 - TM.

    ``rows``: rho, delta_rho, total_snap_count, tm_score of the runs that succeeded. The last correlation needs
    ``least`` runs with a TM-score; n_tm is their number. Nulls and NaN are left out.
    """
    own = rows.agg(F.count(stats.given("rho")).alias("n"), F.count_if(stats.given("delta_rho") > 0).alias("wins")).join(F.broadcast(stats.quantiles(rows, "rho", {"median_rho": 0.5})))  # one row each
    own = own.select("n", "median_rho", "wins").withColumn("win_pct", 100.0 * F.col("wins") / F.nullif(F.col("n"), F.lit(0)))
    scored = rows.where(stats.given("tm_score").isNotNull()).select(F.col("total_snap_count").cast("double").alias("snaps"), (1 - F.col("tm_score")).alias("far"))
    tm = stats.with_p_value(stats.spearman(scored, "snaps", "far"), "rho").select(F.col("n").alias("n_tm"), *[F.when(F.col("n") >= least, F.col(c)).alias(f"{c}_tm") for c in ("rho", "p")])
    return own.join(F.broadcast(tm))  # one row each


def ratio_gate(rows: DataFrame, ratio: str, bar: float) -> DataFrame:
    """Median of speed ratios and whether it passes the bar; nulls and NaN are left out, and no ratios don't pass."""
    out = rows.agg(F.count(stats.given(ratio)).alias("n")).join(F.broadcast(stats.quantiles(rows, ratio, {"median_ratio": 0.5})))  # one row each
    return out.withColumn("gate", F.when(F.col("median_ratio") > bar, "PASS").otherwise("FAIL"))
