"""N-gram Jaccard join of documents over a prefix tree.

1. Every document becomes its set of hashed word shingles. Documents with equal sets form a class,
   found by aggregating a 128-bit signature; only the class's first member goes on.
2. Blocks of documents ask buckets of shingles in how many documents each shingle stands (see
   ``exchange``). Shingles are ordered by that number, then by hash, rare ones first. A document
   that shares fewer shingles with any others than the least overlap asked of a partner is done.
3. The others send the first shingles of their order that a partner must meet (the prefix). Each
   shingle's documents are tied to the smallest of them, a star for each shingle and never all pairs;
   connected components of these stars are the neighbourhoods in which partners can be.
4. A neighbourhood's ordered sets go into a prefix tree in one task. A search through the
   documents not reached yet starts from each new one: the walk down the tree shares the overlap
   of common beginnings and leaves out subtrees whose remaining lengths can't reach the bound.
5. Neighbourhoods grow together as the corpus grows. One that is too large for a task is searched by
   shingle instead, as linked documents share one of their prefixes: first the documents of each
   rarest shingle and of each commonest one, which ties copies together at one row a document each, then
   those of every shingle whose documents are still of several components. There the documents outside
   the largest component ask all others. Documents of one shingle that are too many for a task are cut
   into parts that share some of them; in the last round each part gets all that ask.
6. The links found give the components.

Only links between documents not connected yet are searched for, so a dense group costs about one
comparison a member, and no link between components is lost.

Defined results: a document of fewer words than a shingle is one shingle of all its words; one
without words, or with null text, has an empty set and is linked with nothing. Null identifiers rank
last within a group. Repeated rows are documents of their own with equal sets. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import MESSAGE, answers, blocks, message, n_buckets, pack, received, send, steady, table, unpack
from tessera.llm.text import lean, mix64, token_hashes
from tessera.operators.components import connected_components
from tessera.session import checkpoint, saved

WORDS, PERCENT = 5, 80
#: Documents of a neighbourhood or a shingle in one task, in a part of a larger one, and those that parts share.
TASK_DOCS, PART_DOCS, SHARED_DOCS = 1000, 500, 32
SHINGLES, TEXTS, FIRST = 0, 9, 8
BLOCK_BYTES = 8 << 20
#: Odd multipliers by place in a shingle.
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct shingles of the texts, one after another, each text's sorted; and how many each has."""
    h, n = token_hashes(texts)
    at = np.r_[0, np.cumsum(n)]
    whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        whole += h[j : j + len(whole)] * _FACTORS[j]
    whole = mix64(whole)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(n):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo >= words:
            x = np.unique(whole[lo : hi - words + 1])
        else:
            x = mix64((h[lo:hi] * _FACTORS[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
        out.append(x)
        sizes[i] = len(x)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a partner of a document of ``n`` has in common with it at least."""
    return -(-percent * n // 100)


class Tree:
    """Ordered sets as a compressed prefix tree in arrays, built from the sorted sets."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, members: np.ndarray):
        # lexicographic order by big-endian bytes of the ranks
        order = sorted(members.tolist(), key=lambda i: sets[i].astype(">u4").tobytes())
        self.docs = np.array(order, np.int64)
        self.flat = np.concatenate([sets[i] for i in order]) if order else np.empty(0, np.int64)
        m = np.array([len(sets[i]) for i in order], np.int64)
        self.base = np.cumsum(m) - m
        d = len(order)
        common = np.zeros(d, np.int64)
        for j in range(1, d):
            a, b = sets[order[j - 1]], sets[order[j]]
            k = min(len(a), len(b))
            diff = np.flatnonzero(a[:k] != b[:k])
            common[j] = diff[0] if len(diff) else k
        nodes: list[list] = []  # first leaf, last leaf, start depth, stop depth, parent

        def build():
            stack = [(0, d, 0, -1)]
            while stack:
                lo, hi, depth, parent = stack.pop()
                stop = m[lo] if hi - lo == 1 else max(depth, int(common[lo + 1 : hi].min()))
                node = len(nodes)
                nodes.append([lo, hi, depth, stop, parent])
                if hi - lo > 1:
                    cuts = lo + 1 + np.flatnonzero(common[lo + 1 : hi] <= stop)
                    edges = [lo, *cuts.tolist(), hi]
                    stack.extend((a, b, int(stop), node) for a, b in zip(edges, edges[1:]))

        if d:
            build()
        t = np.array(nodes, np.int64).reshape(-1, 5)
        self.lo, self.hi, self.start, self.stop, self.parent = t.T
        leaf_n, leaf_m = np.asarray(sizes)[self.docs] if d else np.empty(0, np.int64), m
        self.least_n = np.array([leaf_n[a:b].min() for a, b in zip(self.lo, self.hi)], np.int64)
        self.most_m = np.array([leaf_m[a:b].max() for a, b in zip(self.lo, self.hi)], np.int64)
        self.children = np.argsort(self.parent, kind="stable")
        self.child_at = np.searchsorted(self.parent[self.children], np.arange(-1, len(t) + 1))

    def search(self, own: np.ndarray, n: int, percent: int, open_: np.ndarray, mask: np.ndarray) -> list[int]:
        """Documents among the ``open_`` ones that link to the set ``own`` of a document of ``n`` shingles."""
        if not len(self.docs):
            return []
        mask[own] = True
        waiting = np.r_[0, np.cumsum(open_[self.docs])]
        nodes, overlap, found = np.array([0]), np.array([0]), []
        while len(nodes):
            lo, a, b = self.lo[nodes], self.start[nodes], self.stop[nodes]
            size = b - a
            begin = self.base[lo] + a
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            hits = np.r_[0, np.cumsum(mask[self.flat[at]])]
            ends = np.cumsum(size)
            overlap = overlap + hits[ends] - hits[ends - size]
            last = np.where(b > 0, self.flat[np.maximum(self.base[lo] + b - 1, 0)], -1)
            left = len(own) - np.searchsorted(own, last, side="right")
            most = overlap + np.minimum(left, self.most_m[nodes] - b)
            # o / (n + m - o) >= p / 100  <=>  (100 + p) o >= p (n + m)
            keep = ((100 + percent) * most >= percent * (n + self.least_n[nodes])) & (waiting[self.hi[nodes]] > waiting[lo])
            nodes, overlap = nodes[keep], overlap[keep]
            leaf = self.hi[nodes] - self.lo[nodes] == 1
            found += self.docs[self.lo[nodes[leaf]]].tolist()
            inner, overlap = nodes[~leaf], overlap[~leaf]
            first, stop = self.child_at[inner + 1], self.child_at[inner + 2]
            k = stop - first
            nodes = self.children[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)]
            overlap = np.repeat(overlap, k)
        mask[own] = False
        return found


def link(sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT) -> np.ndarray:
    """Component (smallest index) of each of some documents, whose sets are sorted ranks of the shared shingles."""
    n, label = len(sets), np.full(len(sets), -1)
    sizes = np.asarray(sizes, np.int64)
    mask = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, bool)
    open_ = np.ones(n, bool)
    tree, held = Tree(sets, sizes, np.arange(n)), n
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        label[root], todo = root, [root]
        while todo:
            left = int(open_.sum())
            if not left:
                break
            if left < held // 2:
                tree, held = Tree(sets, sizes, np.flatnonzero(open_)), left
            i = todo.pop()
            for j in tree.search(sets[i], int(sizes[i]), percent, open_, mask):
                if open_[j]:
                    open_[j] = False
                    label[j] = root
                    todo.append(j)
    return label


def connect(sets: list[np.ndarray], sizes: list[int], component: list[int], own: np.ndarray, ask: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join known components: each document of ``ask`` searches the ``own`` ones of other components."""
    label = np.unique(component, return_inverse=True)[1]
    sizes = np.asarray(sizes, np.int64)
    mask = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, bool)
    tree, alive, whole, out = Tree(sets, sizes, np.flatnonzero(own)), own.copy(), own.all(), []
    for q in np.flatnonzero(ask):
        open_ = alive & (label != label[q])
        if open_.any():
            for j in tree.search(sets[q], int(sizes[q]), percent, open_, mask):
                if label[j] != label[q]:
                    out.append((int(q), j))
                    label[label == label[j]] = label[q]
        if whole:  # all have been compared with it
            alive[q] = False
    return out


def _ranked(held: list[dict]) -> list[np.ndarray]:
    """Shared shingles of some documents by their rank in the common order, rare ones first."""
    h = np.concatenate([x["h"] for x in held])
    f = np.concatenate([x["f"] for x in held])
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, f[first]))] = np.arange(len(u))
    return np.split(rank[back], np.cumsum([len(x["h"]) for x in held])[:-1])


def _groups(group: pa.Table, names: tuple):
    """Rows of a task by the columns ``names``, in order of the row: place in the table of each."""
    keys = sorted(zip(*[group.column(c).to_pylist() for c in (*names, "row")], range(group.num_rows)))
    lo = 0
    for hi in range(1, len(keys) + 1):
        if hi == len(keys) or keys[hi][: len(names)] != keys[lo][: len(names)]:
            yield [k[-1] for k in keys[lo:hi]]
            lo = hi


def _edges(found: list[tuple]) -> pa.Table:
    return pa.table([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _by_neighbourhood(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Links (u, v) of documents (component, row, n, shared), a neighbourhood in one task."""

    @lean
    def join(group: pa.Table) -> pa.Table:
        out, row, n, shared = [], group.column("row").to_pylist(), group.column("n").to_pylist(), group.column("shared")
        for at in _groups(group, ("component",)):
            label = link(_ranked([unpack(shared[i].as_py()) for i in at]), [n[i] for i in at], percent)
            out += [(row[at[i]], row[at[j]]) for i, j in enumerate(label) if j != i]
        return _edges(out)

    shard = F.pmod(F.xxhash64("component"), F.lit(8 * buckets))
    return sets.select(shard.alias("shard"), "component", "row", "n", "shared").groupBy("shard").applyInArrow(join, "u long, v long")


def _by_shingle(groups: DataFrame, sets: DataFrame, known: DataFrame | None, every: bool, buckets: int, percent: int) -> DataFrame:
    """Links (u, v) between components of the documents of each group (g, k, row); with ``every`` all that there are.

    ``known``: (id, component) of documents that were linked before.
    """
    m = groups if known is None else groups.join(known.withColumnRenamed("id", "row"), "row", "left")
    m = m.withColumn("component", F.col("row") if known is None else F.coalesce("component", "row"))
    main = m.groupBy("g", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    m = m.join(main, "g").withColumn("ask", F.col("component") != F.col("main"))
    m = m.withColumn("parts", F.when(F.col("k") > TASK_DOCS, F.ceil(F.col("k") / PART_DOCS)).otherwise(1).cast("int"))
    m = m.withColumn("home", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    copied = F.col("ask") if every else F.pmod(F.xxhash64(F.lit(1), "row"), F.col("k")) < SHARED_DOCS
    m = m.withColumn("part", F.explode(F.when(copied, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))))
    own = (F.col("part") == F.col("home")) | F.lit(not every)
    shard = F.pmod(F.xxhash64("g", "part"), F.lit(8 * buckets))
    m = m.select("g", "part", "row", "component", "ask", own.alias("own"), shard.alias("shard")).join(sets.select("row", "n", "shared"), "row")

    @lean
    def join(group: pa.Table) -> pa.Table:
        out, shared = [], group.column("shared")
        row, n, component, own, ask = (group.column(c).to_pylist() for c in ("row", "n", "component", "own", "ask"))
        for at in _groups(group, ("g", "part")):
            flags = [np.array([x[i] for i in at], bool) for x in (own, ask)]
            found = connect(_ranked([unpack(shared[i].as_py()) for i in at]), [n[i] for i in at], [component[i] for i in at], *flags, percent)
            out += [(row[at[i]], row[at[j]]) for i, j in found]
        return _edges(out)

    return m.groupBy("shard").applyInArrow(join, "u long, v long")


def _links(sets: DataFrame, tokens: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Links (u, v) that give the components of documents (component, k, row, n, shared) with their prefixes (u, token)."""
    links = saved(_by_neighbourhood(sets.where(F.col("k") <= TASK_DOCS), buckets, percent), "jaccard-links")
    large = sets.where(F.col("k") > TASK_DOCS).select("row", "n", "shared")
    if large.isEmpty():
        return links
    large = saved(large, "jaccard-large")
    own = tokens.join(large.select(F.col("row").alias("u")), "u", "left_semi")
    sizes = own.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = saved(own.join(sizes, "token").select(F.col("token").alias("g"), "k", F.col("u").alias("row")), "jaccard-tokens")
    found = None
    for pick in (F.min_by, F.max_by):
        known = None if found is None else connected_components(found)
        one = own.groupBy("row").agg(pick(F.struct("g", "k"), F.struct("k", "g")).alias("x")).select("x.g", "row")
        one = one.join(one.groupBy("g").agg(F.count(F.lit(1)).alias("k")), "g")
        part = saved(_by_shingle(one, large, known, False, buckets, percent), "jaccard-links")
        found = part if found is None else found.unionByName(part)
    known = connected_components(found)
    left = own.join(known.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    # shingles with the same documents need one search
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(f"x{i}") for i in (1, 2)]
    left = left.groupBy("g", "k").agg(F.min("component").alias("a"), F.max("component").alias("b"), *hashes).where("a <> b").groupBy("k", "x1", "x2").agg(F.min("g").alias("g"))
    part = saved(_by_shingle(own.join(left.select("g"), "g", "left_semi"), large, known, True, buckets, percent), "jaccard-links")
    return links.unionByName(found).unionByName(part)


def _ask(src: DataFrame, words: int, buckets: int) -> DataFrame:
    @lean
    def ask(batches):
        for block, (_, texts, _) in blocks(batches, 1, BLOCK_BYTES):
            flat, _ = shingle_sets(texts, words)
            keys, n = np.unique(flat, return_counts=True)
            yield message(list(send(SHINGLES, block, buckets, keys, n=n)))

    return src.mapInArrow(ask, MESSAGE)


def _count(group: pa.Table) -> pa.Table:
    """In how many documents each shingle stands, 255 at most (enough to order by), back to every block."""
    parts = list(received(group))
    keys = np.concatenate([x["sorted"] for *_, x in parts])
    n = np.concatenate([x["n"] for *_, x in parts]).astype(np.int64)
    _, back = np.unique(keys, return_inverse=True)
    total = np.minimum(np.bincount(back, weights=n), 255).astype(np.uint8)[back]
    rows, lo = [], 0
    for kind, bucket, block, x in parts:
        hi = lo + len(x["sorted"])
        rows.append((kind, bucket, block, pack({"n": total[lo:hi]})))
        lo = hi
    return table(rows)


def signatures(src: DataFrame, words: int) -> DataFrame:
    """block, row, doc_id, n and a signature (s1, s2) of the set of every row."""
    @lean
    def sign(batches):
        for block, (rows, texts, ids) in blocks(batches, 1, BLOCK_BYTES):
            flat, n = shingle_sets(texts, words)
            at = np.r_[0, np.cumsum(n)]
            one, two = (np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)] for x in (mix64(flat), mix64(flat ^ np.uint64(0x5851F42D4C957F2D))))
            yield pa.record_batch([pa.array(np.full(len(rows), block, np.int64)), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(n), pa.array((one[at[1:]] - one[at[:-1]]).view(np.int64)), pa.array((two[at[1:]] - two[at[:-1]]).view(np.int64))], names=["block", "row", "doc_id", "n", "s1", "s2"])

    return src.mapInArrow(sign, "block long, row long, doc_id long, n long, s1 long, s2 long")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id, first (the row that stands for its group)."""
    own = steady(docs.select(docs[text].alias("t"), docs[doc_id].cast("long").alias("doc_id")))
    buckets = n_buckets(own)
    src = own.select(F.monotonically_increasing_id().alias("row"), "t", "doc_id", F.spark_partition_id().alias("p"))
    marked = saved(signatures(src, words), "jaccard-rows")
    # the first member of a class: smallest doc_id, nulls last, then the first row
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = checkpoint(marked.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(rank).alias("first")).select("s1", "s2", "n", F.col("first.row").alias("class"), F.col("first.doc_id").alias("class_id")))

    @lean

    def texts(batches):
        for block, (rows, held, _) in blocks(batches, 1, BLOCK_BYTES):
            flat, n = shingle_sets(held, words)
            yield message([(TEXTS, 0, block, pack({"flat": flat, "n": n, "row": np.array(rows, np.int64)}))])

    counts = saved(_ask(src, words, buckets).groupBy("bucket").applyInArrow(_count, MESSAGE), "jaccard-counts")
    firsts = marked.select("block", "row").join(classes.select(F.col("class").alias("row")), "row", "left_semi")

    def listed(group: pa.Table) -> pa.Table:
        return table([(FIRST, 0, group.column("block")[0].as_py(), pack({"row": np.sort(group.column("row").to_numpy())}))])

    @lean

    def choose(group: pa.Table) -> pa.Table:
        """Of each class that can have partners: its shared shingles in order, and the prefix of them."""
        parts = list(received(group))
        own = [x for k, _, _, x in parts if k == TEXTS]
        first = [x["row"] for k, _, _, x in parts if k == FIRST]
        got = answers(parts, SHINGLES)
        out = {k: [] for k in ("row", "n", "prefix", "shared")}
        if own and first and got:
            x = own[0]
            flat, sizes = x["flat"], x["n"].astype(np.int64)
            order = np.argsort(flat)
            step = np.r_[False, flat[order[1:]] != flat[order[:-1]]]
            df = np.empty(len(flat), np.uint8)
            df[order] = got["n"][np.cumsum(step)]
            at = np.r_[0, np.cumsum(sizes)]
            together = np.r_[0, np.cumsum(df > 1)]
            able = (together[at[1:]] - together[at[:-1]] >= least_overlap(sizes, percent)) & (sizes > 0)
            for i in np.flatnonzero(able & np.isin(x["row"], first[0])):
                f, h = df[at[i] : at[i + 1]], flat[at[i] : at[i + 1]]
                n, shared = len(h), f > 1
                m = int(shared.sum())
                f, h = f[shared], h[shared]
                order = np.lexsort((h, f))
                f, h = f[order], h[order]
                out["row"].append(int(x["row"][i]))
                out["n"].append(n)
                out["prefix"].append(h[: m - least_overlap(n, percent) + 1].view(np.int64))
                out["shared"].append(pack({"f": f, "h": h}))
        return pa.table([pa.array(out["row"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["shared"], pa.binary())], names=list(out))

    asked = src.mapInArrow(texts, MESSAGE).unionByName(counts).unionByName(firsts.groupBy("block").applyInArrow(listed, MESSAGE))
    chosen = saved(asked.groupBy("block").applyInArrow(choose, "row long, n long, prefix array<long>, shared binary"), "jaccard-sets")

    # stars: every document of a prefix shingle with the smallest of them
    tokens = chosen.select(F.col("row").alias("u"), F.explode("prefix").alias("token"))
    stars = tokens.groupBy("token").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "v")
    near = connected_components(tokens.join(stars, "token").where("u <> v").select("u", "v"))
    sized = near.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    sets = chosen.select("row", "n", "shared").join(near.withColumnRenamed("id", "row"), "row").join(sized, "component")
    links = _links(sets, tokens, buckets, percent)
    groups = connected_components(links)
    named = classes.join(groups.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), F.col("class_id"), F.col("class"))).alias("first"))
    known = checkpoint(named.join(least, "component").select("s1", "s2", "n", F.col("first.class_id").alias("component_id"), F.col("first.class").alias("first_row")))
    full = marked.where("n > 0").join(known, ["s1", "s2", "n"]).select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("first_row")).alias("first"))
    empty = marked.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.unionByName(empty)


def keep_first(docs: DataFrame, **named) -> DataFrame:
    """One row of each group of ``docs``, with their own columns: that with the smallest identifier."""
    docs, names = steady(docs), docs.columns
    stay = components(docs, **named).where("first").select("row")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in names]).alias("_c"))
    return own.join(stay, "row", "left_semi").select(*[F.col("_c").getField(c).alias(c) for c in names])
