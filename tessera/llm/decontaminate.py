"""Benchmark decontamination with suffix arrays of the training text.

Each block of documents becomes a word-level suffix array. Only suffixes that start like some benchmark
suffix go into it (same first word, and same second one unless the item has only one), as no other can
hold a match, and their sort keys are cut at the window's length. Every benchmark suffix is
binary-searched in every block's array; the range it falls in gives the places that share a whole
window. Places that follow each other on one diagonal join to the longest verbatim matches with
their locations, and everything else is read off those: the words hit, the items, the documents to
remove. Work is map-only: no shuffle, no grouping.

The benchmark goes to the executors in slices of at most ``slice_bytes`` of text. One slice keeps the
plan map-only. Of several, each makes a pass of its own over the documents, whose matches are written
and its broadcast destroyed before the next; the matches are then put together by the texts' digests.

Defined results: null text has no words; an item without words has no windows; an item shorter
than a window is one window by itself; repeated items and documents each count as a row; a null
item_id takes part in hits and in the number of items but not in the list of identifiers. Of equally
long matches the one whose item_id sorts first (nulls last) and then the leftmost counts as the
longest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lean, word_tokens
from tessera.session import saved

WINDOW = 10
#: Bytes of benchmark text sent to the executors at once.
SLICE_BYTES = 4 << 20
#: Bytes of documents in one suffix array.
BLOCK_BYTES = 8 << 20
#: Shared windows that are joined to matches at once; those of one item in one block stay together.
MOST_HITS = 1 << 21


class Index:
    """The benchmark's suffixes: items as runs of word numbers, and where their windows start."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.words, self.items = window, {}, [item for item, _ in items]
        runs = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in word_tokens(text)], np.uint32) for _, text in items]
        size = np.array([len(r) for r in runs], np.int64)
        k = np.minimum(size, window)
        n = np.where(size > 0, size - k + 1, 0)
        self.owner = np.repeat(np.arange(len(runs)), n)
        self.within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.length = np.repeat(k, n)
        # zeros after each item, so that a window never reaches into the next one
        self.flat = np.concatenate([np.r_[r, np.zeros(window, np.uint32)] for r in runs]) if runs else np.empty(0, np.uint32)
        self.start = self.within + (np.cumsum(size + window) - size - window)[self.owner] if runs else self.within
        self.width = len(self.words) + 1
        self.single, self.starts = np.zeros(self.width, bool), np.zeros(self.width, bool)
        self.single[[r[0] for r in runs if len(r) == 1]] = True
        pairs = [r[:-1].astype(np.int64) * self.width + r[1:] for r in runs]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.starts[self.pairs // self.width] = True
        self.starts |= self.single

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys just before and just after all texts that start with a window."""
        rows = self.flat[self.start[:, None] + np.arange(self.window)].reshape(-1, self.window)
        over = rows.copy()
        over[np.arange(self.window) >= self.length[:, None]] = 0xFFFFFFFF
        return _keys(rows), _keys(over)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{4 * rows.shape[1]}")


def find(index: Index, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and (text, first word, number of words, item, first word in it) of every longest match."""
    get, w = index.words.get, index.window
    arrays = [np.array([get(x, 0) for x in word_tokens(t)], np.int64) for t in texts]
    counts = np.array([len(a) for a in arrays], np.int64)
    nothing = np.empty((0, 5), np.int64)
    # a zero after each text keeps suffixes from crossing into the next one
    ends = np.cumsum(counts + 1)
    flat = np.zeros((ends[-1] if len(ends) else 0) + w, np.int64)
    for a, e in zip(arrays, ends):
        flat[e - 1 - len(a) : e - 1] = a
    at = np.flatnonzero(index.starts[flat])
    if len(at):
        pair = flat[at] * index.width + flat[at + 1]
        spot = np.searchsorted(index.pairs, pair)
        known = np.zeros(len(at), bool)
        if len(index.pairs):
            known = index.pairs[np.minimum(spot, len(index.pairs) - 1)] == pair
        at = at[known | index.single[flat[at]]]
    if not len(at) or not len(index.start):
        return counts, nothing
    rows = flat[at[:, None] + np.arange(w)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    array, at = keys[order], at[order]
    low_key, high_key = index.bounds
    low = np.searchsorted(array, low_key)
    n = np.searchsorted(array, high_key, side="right") - low
    found = []
    for lo, hi in _groups(n, index.owner):
        which = lo + np.repeat(np.arange(hi - lo), n[lo:hi])
        if not len(which):
            continue
        place = at[np.arange(len(which)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + low[which]]
        d = np.searchsorted(ends, place, side="right")
        p, q, item, k = place - (ends[d] - 1 - counts[d]), index.within[which], index.owner[which], index.length[which]
        by = np.lexsort((p, p - q, item, d))
        d, p, q, item, k = d[by], p[by], q[by], item[by], k[by]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] > p[:-1] + 1)])
        last = np.r_[first[1:], len(d)] - 1
        found.append(np.stack([d[first], p[first], p[last] + k[last] - p[first], item[first], q[first]], 1))
    found = np.concatenate(found) if found else nothing
    return counts, found[np.argsort(found[:, 0], kind="stable")]


def _groups(n: np.ndarray, owner: np.ndarray):
    """Ranges of suffixes with about ``MOST_HITS`` hits, cut between items."""
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    upto, lo, held = np.r_[0, np.cumsum(n)], 0, 0
    for h in heads[1:]:
        if upto[h] - held >= MOST_HITS:
            yield lo, h
            lo, held = h, upto[h]
    yield lo, len(n)


def _blocks(batch: pa.RecordBatch, column: int):
    texts, start, held = batch.column(column).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK_BYTES:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _slices(benchmark: DataFrame, item_id: str, text: str, slice_bytes: int):
    """Lists of items with at most ``slice_bytes`` of text, or one item."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if held and size + len(r.t or "") > slice_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t or "")
    yield held


def _covered(start: np.ndarray, length: np.ndarray) -> int:
    """Words in the union of runs."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + length)[order])
    return int((stop - np.maximum(start, np.r_[0, stop[:-1]])).clip(0).sum()) if len(start) else 0


MATCH = "n_hit long, n_items long, items_sha256 string, longest_words long, longest_item string, longest_word long"
NOTHING = (0, 0, hashlib.sha256(b"").hexdigest(), 0, None, None)


def _verdict(start: np.ndarray, length: np.ndarray, item: np.ndarray, names: list) -> tuple:
    """The fields of ``MATCH`` from a document's longest matches; ``names`` by number of item."""
    if not len(start):
        return NOTHING
    own = np.unique(item)
    listed = sorted(names[i] for i in own if names[i] is not None)
    most = int(length.max())
    name, at = min(((names[i] is None, names[i] or ""), int(p)) for p, n, i in zip(start, length, item) if n == most)
    return _covered(start, length), len(own), hashlib.sha256(",".join(listed).encode()).hexdigest(), most, None if name[0] else name[1], at


def _listed(b: pa.RecordBatch, index: Index, names: list[str]):
    """Matches of a batch of (identifier, text): identifier, item_id, number of the item, first words, number of words."""
    for base, texts in _blocks(b, 1):
        _, m = find(index, texts)
        if len(m):
            d, p, n, item, q = m.T
            yield pa.record_batch([b.column(0).take(pa.array(base + d)), pa.array([index.items[x] for x in item], pa.string()), pa.array(item), pa.array(p), pa.array(q), pa.array(n)], names=names)


def _passes(docs: DataFrame, key, kind: str, text: str, slices, window: int) -> DataFrame:
    """Matches by ``key``, with the number of the slice: a pass for each slice, whose broadcast is destroyed after it."""
    spark, out = docs.sparkSession, None
    names = ["key", "item_id", "item", "doc_word", "item_word", "n_words"]
    for number, items in enumerate(slices):
        held = spark.sparkContext.broadcast(Index(items, window))

        @lean
        def search(batches, held=held):
            for b in batches:
                yield from _listed(b, held.value, names)

        part = docs.select(key.alias("key"), F.col(text).alias("t")).mapInArrow(search, f"key {kind}, item_id string, item long, doc_word long, item_word long, n_words long")
        part = saved(part.withColumn("slice", F.lit(number)), "benchmark-matches")
        held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, doc_word, item_word, n_words."""
    found = _passes(docs, F.col(doc_id).cast("long"), "long", text, _slices(benchmark, item_id, text, slice_bytes), window)
    return found.select(F.col("key").alias("doc_id"), "item_id", "doc_word", "item_word", "n_words")


def _combine(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    numbers = {x: i for i, x in enumerate(sorted({(r["slice"], r["item"]) for r in rows}))}
    names: list = [None] * len(numbers)
    for r in rows:
        names[numbers[r["slice"], r["item"]]] = r["item_id"]
    column = lambda c: np.array([r[c] for r in rows], np.int64)
    found = _verdict(column("doc_word"), column("n_words"), np.array([numbers[r["slice"], r["item"]] for r in rows]), names)
    return pa.table([pa.array([x], t) for x, t in zip((rows[0]["key"], *found), _TYPES)], names=["key", *_FIELDS])


_FIELDS = [f.split()[0] for f in MATCH.split(", ")]
_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def score(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW, slice_bytes: int = SLICE_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match, and the columns to carry.

    The longest match is told by longest_words (0 where there is none), longest_item and longest_word, its first word in the document.
    """
    spark, slices = docs.sparkSession, _slices(benchmark, item_id, text, slice_bytes)
    head, more = next(slices), next(slices, None)
    carried = [docs[c].alias(f"_c_{c}") for c in carry or []]
    order = ["doc_id", "n_words", *_FIELDS[:3], "contaminated", *_FIELDS[3:], *[f"_c_{c}" for c in carry or []]]
    if more is not None:

        def every():
            yield head
            yield more
            yield from slices

        # a text's matches depend on the text alone, so its digest names it whatever row or scan it comes from
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).cast("binary")
        found = _passes(docs, digest, "binary", text, every(), window).distinct().groupBy("key").applyInArrow(_combine, f"key binary, {MATCH}")
        n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), n_words.alias("n_words"), digest.alias("key"), *carried)
        blank = {f: F.coalesce(f, F.lit(x).cast(k.split()[1])) for f, x, k in zip(_FIELDS, NOTHING, MATCH.split(", "))}
        return rows.join(saved(found, "benchmark-hits"), "key", "left").withColumns(blank).withColumn("contaminated", F.col("n_hit") > 0).select(*order)
    held = spark.sparkContext.broadcast(Index(head, window))
    src = docs.select(F.col(text).alias("_t"), F.col(doc_id).cast("long").alias("_id"), *carried)

    @lean
    def judge(batches):
        index = held.value
        for b in batches:
            words, told = [], []
            for _, texts in _blocks(b, 0):
                counts, m = find(index, texts)
                words += counts.tolist()
                cuts = np.searchsorted(m[:, 0], np.arange(len(texts) + 1))
                told += [NOTHING if lo == hi else _verdict(m[lo:hi, 1], m[lo:hi, 2], m[lo:hi, 3], index.items) for lo, hi in zip(cuts.tolist(), cuts[1:].tolist())]
            fields = [pa.array([x[k] for x in told], t) for k, t in enumerate(_TYPES[1:])]
            yield pa.record_batch([b.column(1), pa.array(words, pa.int64()), *fields[:3], pa.array([x[0] > 0 for x in told], pa.bool_()), *fields[3:], *b.columns[2:]], names=order)

    kinds = MATCH.split(", ")
    extra = "".join(f", `_c_{c}` {src.schema[f'_c_{c}'].dataType.simpleString()}" for c in carry or [])
    return src.mapInArrow(judge, ", ".join(["doc_id long", "n_words long", *kinds[:3], "contaminated boolean", *kinds[3:]]) + extra)


def remove(docs: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns."""
    names = docs.columns
    scored = score(docs, benchmark, carry=names, **named)
    return scored.where(~F.col("contaminated")).select(*[F.col(f"_c_{c}").alias(c) for c in names])
