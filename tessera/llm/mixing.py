"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A small graph
then routes token capacity from patterns to source quotas; the n-th copy of a pattern's tokens
costs n-1 a token, so repetition is convex and fresh text goes first. Finally documents are chosen
in an order seeded by a hash: all of a pattern's documents get the whole number of copies, and
those first in the order get one more until the pattern's flow is met.

The order is that of the hash, then of the row's number in the table that is written first, so a cut
falls inside a group of equal rows too. No group is ordered in one task: three rounds of 4,096 buckets,
two by hash and one by row number, narrow the cut of each pattern before rows are ordered. What
reaches the driver, and goes back to the executors, is one row per pattern; more than ``MOST_PATTERNS``
of them, or ``MOST_NAMES`` characters of names, are refused with an error.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0; documents of size 0 take 0; repeated rows are documents of their
own, of which any may be taken; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint, saved

COPIES = 3
SEED = 20240607
BITS = 12
#: Patterns, and characters of their names, that the driver and each executor hold.
MOST_PATTERNS, MOST_NAMES = 200_000, 32 << 20


def targets(sizes: dict[str | None, float], weights: dict[str | None, float], most: float = COPIES) -> dict[str | None, float]:
    """Shares of the total by weight; a source stops at ``most`` times its size and the rest is dealt anew."""
    capped: dict[str | None, float] = {s: 0.0 for s in sizes if sizes[s] <= 0}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = sum(weights[s] for s in sizes if s not in capped)
        share = {s: rest * weights[s] / free for s in sizes if s not in capped}
        over = {s: float(most * sizes[s]) for s, x in share.items() if x > most * sizes[s]}
        if not over:
            return share | capped
        capped |= over


def cyclic_weights(sources) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, over the sources by code point with null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in set(sources))
    return {s: float(i % 3 + 1) for i, s in enumerate(order)}


def _in_order(pattern: tuple) -> tuple:
    return tuple((s is None, s or "") for s in pattern)


def route(capacity: dict[tuple, float], quota: dict[str | None, float], copies: int = COPIES) -> dict[tuple, float]:
    """Tokens to take of each pattern: min-cost flow from patterns over sources to the quotas.

    A pattern's n-th copy of its tokens costs n - 1, all else costs nothing; so a cheapest path costs what its first arc
    does, and the flow is filled cost by cost: the greatest flow with one copy, raised to the greatest with two, and so on.
    Each is found by blocking flows over shortest paths. Parts of the graph that share no source are solved by
    themselves. The order of ``capacity`` doesn't matter.
    """
    of = defaultdict(list)
    for p in sorted(capacity, key=_in_order):
        for s in p:
            of[s].append(p)
    seen, taken = set(), {}
    for root in sorted(capacity, key=_in_order):
        if root in seen:
            continue
        part, todo = [], [root]
        seen.add(root)
        while todo:
            p = todo.pop()
            part.append(p)
            for s in p:
                # a source's patterns are looked at once
                for q in of.pop(s, ()):
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
        taken |= _flow({p: capacity[p] for p in part}, {s: quota[s] for p in part for s in p}, copies)
    return taken


def _flow(capacity: dict[tuple, float], quota: dict, copies: int) -> dict[tuple, float]:
    """Flow of each pattern in one part. Only free capacity of patterns, room of sources and flow on arcs are kept."""
    patterns, sources = list(capacity), list(quota)
    at = {s: i for i, s in enumerate(sources)}
    to = [[at[s] for s in p] for p in patterns]
    back: list[list[int]] = [[] for _ in sources]
    free, room = [0.0] * len(patterns), [float(quota[s]) for s in sources]
    flow = [dict.fromkeys(t, 0.0) for t in to]
    for i, t in enumerate(to):
        for s in t:
            back[s].append(i)
    tiny = 1e-9 * max([1.0, *quota.values()])
    for _ in range(copies):
        free = [f + float(capacity[p]) for f, p in zip(free, patterns)]
        while _blocking(to, back, free, room, flow, tiny):
            pass
    return {p: sum(flow[i].values()) for i, p in enumerate(patterns)}


def _blocking(to, back, free, room, flow, tiny) -> bool:
    """Fill all shortest ways from patterns with free tokens to sources with room; False if there are none.

    A way goes from a pattern to a source of its own, and from a source back to a pattern that could send elsewhere
    what it sends there.
    """
    far_p, far_s = [-1] * len(to), [-1] * len(back)
    layer = [i for i, f in enumerate(free) if f > tiny]
    for i in layer:
        far_p[i] = 0
    depth, ends = 0, False
    while layer and not ends:
        hit = []
        for i in layer:
            for s in to[i]:
                if far_s[s] < 0:
                    far_s[s] = depth + 1
                    hit.append(s)
        ends = any(room[s] > tiny for s in hit)
        layer = []
        for s in hit if not ends else ():
            for i in back[s]:
                if far_p[i] < 0 and flow[i][s] > tiny:
                    far_p[i] = depth + 2
                    layer.append(i)
        depth += 2
    if not ends:
        return False
    next_p, next_s = [0] * len(to), [0] * len(back)
    for start in range(len(to)):
        while far_p[start] == 0 and free[start] > tiny:
            # way: pattern, source, pattern, ..., source; each position goes on from where it last stopped
            way = [start]
            while way:
                u = way[-1]
                if len(way) % 2:
                    if next_p[u] == len(to[u]):
                        way.pop()
                        if way:
                            next_s[way[-1]] += 1
                    elif far_s[s := to[u][next_p[u]]] == far_p[u] + 1:
                        way.append(s)
                    else:
                        next_p[u] += 1
                elif far_s[u] == depth - 1:
                    # of the last layer: an end or nothing
                    if room[u] > tiny:
                        break
                    way.pop()
                    next_p[way[-1]] += 1
                elif next_s[u] == len(back[u]):
                    way.pop()
                    next_p[way[-1]] += 1
                elif far_p[i := back[u][next_s[u]]] == far_s[u] + 1 and flow[i][u] > tiny:
                    way.append(i)
                else:
                    next_s[u] += 1
            if not way:
                break
            push = min([free[start], room[way[-1]], *[flow[way[k]][way[k - 1]] for k in range(2, len(way), 2)]])
            for k in range(0, len(way), 2):
                flow[way[k]][way[k + 1]] += push
                if k:
                    flow[way[k]][way[k - 1]] -= push
            free[start] -= push
            room[way[-1]] -= push
    return True


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _cuts(rows: DataFrame, level: int, left: DataFrame) -> DataFrame:
    """For each pattern of ``left`` the bucket of this level in which its remainder ends, and what is left in it."""
    sums = rows.groupBy("pattern", f"b{level}").agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("pattern").orderBy(f"b{level}"))
    run = sums.join(F.broadcast(left), "pattern").withColumn("before", upto - F.col("w"))  # a row per pattern, of a checked number
    # the bucket that holds the cut; none where the remainder is zero
    return run.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("w") >= F.col("left"))).select("pattern", F.col(f"b{level}").alias(f"cut{level}"), (F.col("left") - F.col("before")).alias("left"))


def _checked(found: dict, names: int) -> None:
    if len(found) > MOST_PATTERNS or names > MOST_NAMES:
        raise ValueError(f"{len(found)} patterns of {names} characters; the flow holds {MOST_PATTERNS} of {MOST_NAMES} at most")


def mix(docs: DataFrame, sources: str = "source", size: Column | None = None, doc_id: str = "doc_id", weights=None, copies: int = COPIES, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and the carried columns.

    ``sources`` is a string column, or an array of strings for documents of several sources;
    source_size and target are then sums over a document's sources.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)[sources].startswith("array")
    pattern = F.array_sort(F.array_distinct(docs[sources])) if many else F.array(docs[sources].cast("string"))
    words = n_words(docs["text"]) if size is None else size
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), words.alias("size"), pattern.alias("member"), *[docs[c].alias(f"_c_{c}") for c in carry or []])
    # null can't be joined on: a pattern is named by its text, with a mark before each value
    name = F.concat_ws("\x1f", F.transform("member", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-"))))
    h = F.xxhash64(F.lit(seed), "doc_id", "size", name)
    rows = rows.withColumns({"pattern": name, "h": h, "n": F.monotonically_increasing_id()})
    mask = F.lit((1 << BITS) - 1)
    buckets = {
        "b1": F.shiftrightunsigned("h", 64 - BITS), "b2": F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND(mask),
        # equal rows have equal hashes: these are told apart by a hash of their numbers
        "r": F.xxhash64(F.lit(seed), "n"), "b3": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "n"), 64 - BITS),
    }
    # written once, so that numbers hold in every pass
    source = saved(rows, "mixing").withColumns(buckets)
    light = source.select("doc_id", "size", "member", "pattern", "h", "r", "b1", "b2", "b3")
    found, names = {}, 0
    for x in light.groupBy("pattern").agg(F.first("member").alias("member"), F.sum("size").alias("w")).toLocalIterator():
        found[x.pattern] = (tuple(x.member), float(x.w))
        names += len(x.pattern)
        _checked(found, names)
    size_of = defaultdict(float)
    for member, w in found.values():
        for s in member:
            size_of[s] += w
    weights = weights or cyclic_weights(size_of)
    goal = targets(dict(size_of), weights, copies)
    flow = route({m: w for m, w in found.values()}, goal, copies)
    plan = []
    for p, (m, w) in found.items():
        whole = min(copies, int(flow[m] / w + 1e-9)) if w else 0
        plan.append((p, int(sum(size_of[s] for s in m)), float(sum(goal[s] for s in m)), whole, max(0.0, flow[m] - whole * w) if whole < copies else 0.0))
    plan = spark.createDataFrame(plan, "pattern string, source_size long, target double, whole int, left double")
    cuts, inner = [plan.select("pattern", "left")], light.drop("member")
    for level in (1, 2, 3):
        if level > 1:
            inner = inner.join(F.broadcast(cuts[-1].drop("left").withColumnRenamed(f"cut{level - 1}", f"b{level - 1}")), ["pattern", f"b{level - 1}"])
        cuts.append(checkpoint(_cuts(inner, level, cuts[-1])))
    last = inner.join(F.broadcast(cuts[3].withColumnRenamed("cut3", "b3")), ["pattern", "b3"])
    order = F.struct("h", "r")
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "r").rowsBetween(Window.unboundedPreceding, 0))
    # the document in which the remainder ends is taken if half of it at least still fits
    edge = last.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("left")).groupBy("pattern").agg(F.max(order).alias("edge"))
    limits = plan
    for x in (*[c.drop("left") for c in cuts[1:]], edge):
        limits = limits.join(x, "pattern", "left")
    joined = source.join(F.broadcast(checkpoint(limits)), "pattern")
    within = (F.col("b3") < F.col("cut3")) | ((F.col("b3") == F.col("cut3")) & (order <= F.col("edge")))
    for level in (2, 1):
        within = (F.col(f"b{level}") < F.col(f"cut{level}")) | ((F.col(f"b{level}") == F.col(f"cut{level}")) & within)
    more = F.when(F.col("left") <= 0, False).otherwise(F.coalesce(within, F.lit(False)))
    taken = F.col("size") * (F.col("whole") + more.cast("int"))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_c_{c}") for c in carry or []])


def select(docs: DataFrame, **named) -> DataFrame:
    """The documents that the mix takes at least once, with their own columns."""
    names = docs.columns
    return mix(docs, carry=names, **named).where(F.col("taken") > 0).select(*[F.col(f"_c_{c}").alias(c) for c in names])
