"""Ordered greedy matching in rounds: every left row in order takes what is left of the partners it likes best.

The plain way goes through the left rows one by one. Here all rows claim at once what earlier rows' last claims leave
them, again and again. A row whose rivals' claims no longer change has its final claims in the next round, so the rounds end
at just the sequential choice, after as many as the longest chain of displacements. A row that no earlier one can rival is
settled and leaves with what it takes; so few rows are left after few rounds. Each round is two running sums, one by
right row and one by left row, over the pairs of rows that aren't settled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint


def take_in_order(pairs: DataFrame, keys: Sequence[str], a: str, b: str, prefer: Sequence[str], n: str | None = None, capacity: str | None = None, most_rounds: int = 10_000) -> tuple[DataFrame, int]:
    """(columns of ``pairs``, taken) of the pairs that take something, and the number of rounds.

    ``pairs``: keys, a, b and what ``a`` prefers by, smallest first and of equals the first ``b``; distinct by (keys, a, b).
    Left rows go in the order of ``a`` within equal keys (null is a key). ``n`` names how much a left row takes in all,
    ``capacity`` how much a right row has; both are 1 without a name. RuntimeError after ``most_rounds``.
    """
    keys, names = list(keys), pairs.columns
    one = F.lit(1).cast("long")
    count = lambda c: one if c is None else F.col(c).cast("long")
    alive = checkpoint(pairs.select(*names, count(n).alias("_n"), count(capacity).alias("_c"), F.lit(0).cast("long").alias("_x")).where("_n > 0 and _c > 0"))
    by_b = Window.partitionBy(*keys, b).orderBy(a)
    by_a = Window.partitionBy(*keys, a).orderBy(*prefer, b)
    own_a, own_b = Window.partitionBy(*keys, a), Window.partitionBy(*keys, b)
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done, rounds = None, 0
    while rounds < most_rounds:
        rounds += 1
        left = alive.withColumn("_room", F.greatest(F.col("_c") - earlier(by_b, "_x"), F.lit(0))).withColumn("_first", F.row_number().over(by_b) == 1)
        want = left.withColumn("_before", earlier(by_a, "_room"))
        claim = F.greatest(F.least(F.col("_room"), F.col("_n") - F.col("_before")), F.lit(0))
        want = want.withColumn("_new", claim)
        # settled: first wherever it may have to look
        want = want.withColumn("_settled", F.bool_and(F.col("_first") | (F.col("_before") >= F.col("_n"))).over(own_a))
        now = checkpoint(want.select(*names, "_n", "_c", F.col("_x").alias("_old"), F.col("_new").alias("_x"), "_settled"))
        told = now.agg(F.count_if(F.col("_old") != F.col("_x")).alias("changed"), F.count_if("_settled").alias("settled"), F.count(F.lit(1)).alias("n")).first()
        last = not told.changed or told.settled == told.n
        found = now.where(F.col("_x") > 0) if last else now.where((F.col("_x") > 0) & F.col("_settled"))
        found = found.select(*names, F.col("_x").alias("taken"))
        done = found if done is None else done.unionByName(found)
        if last:
            return done, rounds
        if told.settled:
            gone = F.sum(F.when(F.col("_settled"), F.col("_x")).otherwise(0)).over(own_b)
            now = checkpoint(now.withColumn("_c", F.col("_c") - gone).where(~F.col("_settled") & (F.col("_c") > 0)))
        alive = now.select(*names, "_n", "_c", "_x")
    raise RuntimeError(f"not matched after {most_rounds} rounds")
