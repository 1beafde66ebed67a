"""Removal of long repeated substrings by a column-wise multi-document transform.

Wanted: for every string of ``length`` bytes of a document, whether it also starts earlier. Inserting
one symbol of each document a round into the transform of whole documents would take as many rounds
as the longest document has bytes, each over files as large as the corpus. So documents are first cut
into short overlapping pieces in such a way that equal strings always meet at the same column:

1. Anchors. Of each string of ``length`` bytes the k-gram with the smallest hash is its anchor (the
   leftmost of equals). Equal strings have equal anchors at equal offsets. Neighbouring strings with
   one anchor form a piece of at most 2 * length - k bytes. Blocks of documents ask buckets how often
   each anchor stands (see ``exchange``); a piece whose anchor stands once holds no repeated string.
   K-grams that are very frequent are chosen as anchors only where nothing else is in reach, which
   keeps pieces with a common line from gathering in one bucket.
2. Construction. Pieces with a repeated anchor go to the anchor's bucket, aligned at the anchor;
   pieces of a block with equal bytes go once. From the last column to the first, every round
   inserts one symbol of each piece in front of its suffix: a stable distribution by symbol gives the
   new order of the suffixes of the collection, and the common prefix of neighbours is one more than
   the least between their old places, or nothing where symbols differ. Only suffixes that start in
   the same column need ordering against each other, as equal strings start in the same column; so a
   round holds one column, one order and one array of common prefixes, in memory, and no transform over
   all columns is kept. A bucket's pieces are in one task; anchors are spread over buckets by hash, and
   the pieces of one anchor are bounded by step 1.
3. Where neighbours have ``length`` symbols in common, all but the earliest are repeats. The
   answers go back to the blocks, which mark the bytes and cut them out.

Exact: bytes decide, hashes only choose and route. Defined results: a null text is empty; earlier
means smaller doc_id (nulls last), then the earlier row of the scan, then the earlier start; texts
shorter than ``length`` have no repeats; of repeated rows the first of the scan keeps the text; other
columns are ignored, and an empty table gives no rows. Kept bytes are joined as bytes, so a cut may split a
character; ``deduplicate`` drops the incomplete bytes when it returns text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm.exchange import MESSAGE, answers, blocks, cut, message, n_buckets, pack, received, send, steady, table, unpack
from tessera.llm.text import lean, mix64
from tessera.session import saved

LENGTH = 100
#: Bytes of an anchor, as a share of the length.
ANCHOR = 0.28
#: An anchor is frequent from this share of all pieces on, and at least so many; 1 / FREQUENT such anchors at most are broadcast, 8 bytes each.
FREQUENT, LEAST_FREQUENT = 1 / 2_000_000, 2000
#: Text in a block and windows handled at once.
BLOCK_BYTES, STEP = 8 << 20, 1 << 17
ANCHORS, PIECES, TEXTS, OFTEN = 0, 1, 9, 8


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    power = {1: data.astype(np.uint64) + np.uint64(1)}
    multiplier, n = np.uint64(0x9E3779B97F4A7C15), 1
    while 2 * n <= k:
        h = power[n]
        power[2 * n] = h[: len(h) - n] * multiplier ^ (h[n:] >> np.uint64(7)) + h[n:]
        multiplier = multiplier * multiplier | np.uint64(1) if n > 32 else np.uint64(int(multiplier) * 0xD1342543DE82EF95 % 2**64 | 1)
        n *= 2
    out, at = None, 0
    while at < k:
        while at + n > k:
            n //= 2
        part = power[n][at : len(data) - k + 1 + at]
        out = part.copy() if out is None else mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + part)
        at += n
    return mix64(out)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    n, m = 1, key
    while 2 * n <= w:
        m = np.minimum(m[: len(m) - n], m[n:])
        n *= 2
    rest = w - n
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


#: Anchors are small hashes, being least ones; this factor spreads their names over all buckets, and its inverse gives the hash back.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GATHER = np.uint64(pow(int(_SPREAD), -1, 2**64))


class Frequent:
    """Test of membership in a bounded set of anchors, given by their names."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys * _GATHER)
        bits = max(16, min(24, 4 + len(self.keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.table[(h >> self.shift).astype(np.int64)]
        at = np.flatnonzero(out)
        spot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        out[at] = self.keys[spot] == h[at]
        return out


def pieces(data: np.ndarray, sizes: np.ndarray, length: int, k: int, often: Frequent | None = None):
    """Pieces of documents that follow each other in ``data``: first string, number of strings, place and name of the anchor."""
    n, w = len(data) - length + 1, length - k + 1
    ends = np.cumsum(sizes)
    inside = np.ones(len(data), bool)
    for e, size in zip(ends.tolist(), sizes.tolist()):
        inside[max(e - length + 1, e - size) : e] = False
    out = []
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        own = np.flatnonzero(inside[lo:hi])
        if not len(own):
            continue
        h = _grams(data[lo : hi + length - 1], k)
        # order by the hash's upper bits, then by place; frequent ones last
        key = h >> np.uint64(21) << np.uint64(20) | np.arange(len(h), dtype=np.uint64)
        if often is not None:
            key |= often(h).astype(np.uint64) << np.uint64(63)
        at = (_least(key, w) & np.uint64((1 << 20) - 1)).astype(np.int64)[own]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out.append((own[first] + lo, np.diff(np.r_[first, len(at)]), at[first] + lo, h[at[first]] * _SPREAD))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]


class Block:
    """Pieces of the documents of a block, in the order of the documents; places count from the document's start."""

    def __init__(self, texts: list[bytes], length: int, k: int, often: Frequent | None):
        sizes = np.array([len(t) for t in texts], np.int64)
        first, self.strings, at, self.hash = pieces(np.frombuffer(b"".join(texts), np.uint8), sizes, length, k, often)
        ends = np.cumsum(sizes)
        self.doc = np.searchsorted(ends, first, side="right")
        begin = (ends - sizes)[self.doc] if len(first) else first
        self.first, self.at = first - begin, at - begin
        self.keys, self.back = np.unique(self.hash, return_inverse=True)

    def ask(self, block: int, buckets: int) -> list:
        return list(send(ANCHORS, block, buckets, self.keys, n=np.bincount(self.back, minlength=len(self.keys))))

    def repeated(self, live: np.ndarray, texts: list[bytes], ids: list, rows: list, length: int):
        """Pieces with a repeated anchor; equal ones of the block name the earliest of them, which alone is sent.

        Returns the pieces to send by hash of the anchor, and for every other piece (piece, the one that is sent).
        """
        own = np.flatnonzero(live[self.back])
        rank = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        place = np.empty(len(texts), np.int64)
        place[rank] = np.arange(len(texts))
        own = own[np.lexsort((self.first[own], place[self.doc[own]]))]
        seen, sent, same = {}, [], []
        for i in own.tolist():
            a = int(self.first[i])
            key = (texts[self.doc[i]][a : a + int(self.strings[i]) + length - 1], int(self.at[i]) - a)
            j = seen.setdefault(key, i)
            if j == i:
                sent.append(i)
            else:
                same.append((i, j))
        sent = np.array(sent, np.int64)
        return sent[np.argsort(self.hash[sent], kind="stable")], same


def repeats(data: np.ndarray, sizes: np.ndarray, offset: np.ndarray, rank: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which strings of which pieces stand in a piece of smaller rank too: flags[piece, anchor's offset in the string].

    ``data``: the pieces' bytes one after another; ``offset``: the anchor's place in its piece.
    """
    m, w = len(sizes), length - k + 1
    flags = np.zeros((m, w), bool)
    if m < 2:
        return flags
    begin = np.cumsum(sizes) - sizes
    right = int((sizes - offset).max())
    lcp_most = np.uint8(min(length, 255))
    order = np.arange(m)
    common = np.zeros(m, np.uint8)
    # one column after the other, from the last to the first
    for x in range(right - 1, -w, -1):
        there = (x >= -offset) & (x < sizes - offset)
        symbol = np.full(m, 256, np.uint16)
        symbol[there] = data[begin[there] + offset[there] + x]
        symbol = symbol[order]
        to = np.argsort(symbol, kind="stable")
        s = symbol[to]
        equal = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] != 256)) + 1
        lo, hi = to[equal - 1] + 1, to[equal]
        fresh = np.zeros(m, np.uint8)
        if len(equal):
            least = common[hi].copy()
            wide = np.flatnonzero(hi > lo)
            if len(wide):
                level = np.log2(hi[wide] - lo[wide] + 1).astype(np.int64)
                steps = [common]
                for j in range(int(level.max())):
                    t = steps[-1].copy()
                    np.minimum(t[: m - (1 << j)], steps[-1][1 << j :], out=t[: m - (1 << j)])
                    steps.append(t)
                steps = np.stack(steps)
                least[wide] = np.minimum(steps[level, lo[wide]], steps[level, hi[wide] - (1 << level) + 1])
            fresh[equal] = np.minimum(least, lcp_most - np.uint8(1)) + np.uint8(1)
        order, common = order[to], fresh
        if x <= 0:
            d = -x
            valid = (offset[order] >= d) & (d >= offset[order] - (sizes[order] - length))
            runs = np.flatnonzero(common < length)
            r = np.where(valid, rank[order], np.iinfo(np.int64).max)
            earliest = np.minimum.reduceat(r, runs)
            late = valid & (r > np.repeat(earliest, np.diff(np.r_[runs, m])))
            flags[order[late], d] = True
    return flags


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    own = steady(docs.select(docs[text].alias("t"), docs[doc_id].cast("long").alias("i")))
    return own.select(F.monotonically_increasing_id().alias("row"), "t", "i", F.spark_partition_id().alias("p"))


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _count(group: pa.Table) -> pa.Table:
    """Which anchors of a bucket stand more than once, back to the blocks; and those that stand very often."""
    parts = list(received(group))
    keys = np.concatenate([x["sorted"] for *_, x in parts])
    u, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([x["n"] for *_, x in parts]), minlength=len(u)).astype(np.int64)
    rows, lo = [], 0
    for kind, bucket, block, x in parts:
        hi = lo + len(x["sorted"])
        rows.append((kind, bucket, block, pack({"live": (total[back[lo:hi]] > 1).astype(np.uint8)})))
        lo = hi
    often = total >= LEAST_FREQUENT
    rows.append((OFTEN, parts[0][1], -1, pack({"sorted": u[often], "n": total[often]})))
    rows.append((PIECES, parts[0][1], -1, pack({"sum": np.array([total.sum()])})))
    return table(rows)


def _above(least: float):
    """Of the anchors that stand very often those that stand ``least`` times."""

    def keep(batches):
        for b in batches:
            for payload in b.column(0):
                x = unpack(payload.as_py())
                yield pa.record_batch([pa.array(x["sorted"][x["n"] >= least].view(np.int64))], names=["anchor"])

    return keep


def marked(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", finish=None, schema: str = "") -> DataFrame:
    """``finish(row, id, bytes, removed mask)`` of every row, as rows of ``schema``."""
    k = max(4, int(length * ANCHOR))
    if length > 255:
        raise ValueError("common prefixes are held in one byte: length is 255 at most")
    spark, src = docs.sparkSession, _source(docs, text, doc_id)
    buckets = n_buckets(src)

    def count(often: Frequent | None) -> DataFrame:
        held = spark.sparkContext.broadcast(often)

        @lean

        def ask(batches):
            for block, (_, texts, _) in blocks(batches, 1, BLOCK_BYTES):
                yield message(Block(_raw(texts), length, k, held.value).ask(block, buckets))

        return saved(src.mapInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(_count, MESSAGE), "repeats-anchors")

    counts = count(None)
    final = counts.where("block = -1")
    total = sum(int(unpack(bytes(r.payload))["sum"][0]) for r in final.where(f"kind = {PIECES}").toLocalIterator())  # a number a bucket
    least = max(LEAST_FREQUENT, total * FREQUENT)
    frequent = final.where(f"kind = {OFTEN}").select("payload").mapInArrow(_above(least), "anchor long").toArrow()  # 1 / FREQUENT at most
    frequent = frequent.column(0).to_numpy().view(np.uint64)
    often = Frequent(frequent) if len(frequent) else None
    if often is not None:
        counts = count(often)
    held = spark.sparkContext.broadcast(often)
    told = counts.where(f"block >= 0 and kind = {ANCHORS}")

    @lean

    def texts(batches):
        for block, (rows, t, ids) in blocks(batches, 1, BLOCK_BYTES):
            raw = _raw(t)
            yield message([(TEXTS, 0, block, pack({"data": np.frombuffer(b"".join(raw), np.uint8), "size": np.array([len(x) for x in raw], np.int64), "row": np.array(rows, np.int64), "id": np.array([i or 0 for i in ids], np.int64), "null": np.array([i is None for i in ids], np.uint8)}))])

    def opened(group: pa.Table):
        parts = list(received(group))
        x = next(x for kind, _, _, x in parts if kind == TEXTS)
        whole, at = x["data"].tobytes(), np.r_[0, np.cumsum(x["size"].astype(np.int64))].tolist()
        raw = [whole[a:b] for a, b in zip(at, at[1:])]
        ids = [None if n else int(i) for n, i in zip(x["null"], x["id"])]
        rows = x["row"].astype(np.int64).tolist()
        block = Block(raw, length, k, held.value)
        live = answers(parts, ANCHORS).get("live", np.empty(0, np.uint8)).astype(bool)
        sent, same = block.repeated(live, raw, ids, rows, length)
        return parts, raw, ids, rows, block, sent, same

    @lean

    def gather(group: pa.Table) -> pa.Table:
        _, raw, ids, rows, b, sent, _ = opened(group)
        name, out = group.column("block")[0].as_py(), []
        at = cut(b.hash[sent], buckets)
        for bucket in range(buckets):
            own = sent[at[bucket] : at[bucket + 1]]
            if len(own):
                doc, first, size = b.doc[own], b.first[own], b.strings[own] + length - 1
                data = b"".join([raw[d][a : a + n] for d, a, n in zip(doc.tolist(), first.tolist(), size.tolist())])
                out.append((PIECES, bucket, name, pack({
                    "data": np.frombuffer(data, np.uint8), "size": size, "offset": b.at[own] - first, "first": first,
                    "id": np.array([ids[d] or 0 for d in doc], np.int64), "null": np.array([ids[d] is None for d in doc], np.uint8), "row": np.array([rows[d] for d in doc], np.int64),
                })))
        return table(out)

    @lean

    def construct(group: pa.Table) -> pa.Table:
        parts = list(received(group))
        column = lambda c: np.concatenate([x[c].astype(np.int64) for *_, x in parts])
        n = [len(x["size"]) for *_, x in parts]
        order = np.lexsort((column("first"), column("row"), column("id"), column("null")))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flags = repeats(np.concatenate([x["data"] for *_, x in parts]), column("size"), column("offset"), rank, length, k)
        at = np.r_[0, np.cumsum(n)]
        return table([(kind, bucket, block, pack({"flags": np.packbits(flags[lo:hi], axis=1).ravel()})) for (kind, bucket, block, _), lo, hi in zip(parts, at, at[1:])])

    asked = src.mapInArrow(texts, MESSAGE)
    flagged = saved(asked.unionByName(told).groupBy("block").applyInArrow(gather, MESSAGE).groupBy("bucket").applyInArrow(construct, MESSAGE), "repeats-flags")

    @lean

    def mark(group: pa.Table) -> pa.Table:
        parts, raw, ids, rows, b, sent, same = opened(group)
        w = length - k + 1
        packed = answers(parts, PIECES).get("flags", np.empty(0, np.uint8))
        flags = np.unpackbits(packed.reshape(len(sent), -1) if len(sent) else np.empty((0, 1), np.uint8), axis=1)[:, :w].astype(bool)
        size = np.array([len(t) for t in raw], np.int64)
        base = np.r_[0, np.cumsum(size + 1)]
        edge = np.zeros(base[-1] + 1, np.int32)

        def cover(start):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)

        i, d = np.nonzero(flags)
        p = sent[i]
        cover(base[b.doc[p]] + b.at[p] - d)
        if same:
            p = np.array([x for x, _ in same])
            n = b.strings[p]
            cover(np.repeat(base[b.doc[p]] + b.first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        gone = np.cumsum(edge, dtype=np.int32, out=edge) > 0
        out = [finish(rows[j], ids[j], raw[j], gone[base[j] : base[j] + size[j]]) for j in range(len(raw))]
        return pa.Table.from_pylist(out, kind)

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return asked.unionByName(told).unionByName(flagged).groupBy("block").applyInArrow(mark, schema)


def _summary(row, i, raw: bytes, gone: np.ndarray) -> dict:
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
    starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return {"doc_id": i, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": starts, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def summary(docs: DataFrame, length: int = LENGTH, **named) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return marked(docs, length, finish=_summary, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **named)


def _text(row, i, raw: bytes, gone: np.ndarray) -> dict:
    flat = np.r_[False, gone, False]
    edges = np.flatnonzero(flat[1:] != flat[:-1]).reshape(-1, 2)
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return {"row": row, "doc_id": i, "text": kept.decode("utf-8", "ignore"), "spans": [{"start": int(a), "stop": int(b)} for a, b in edges]}


def deduplicate(docs: DataFrame, length: int = LENGTH, **named) -> DataFrame:
    """One row per row of ``docs``: row (its number in the scan), doc_id, the text that is left and the byte spans that went."""
    return marked(docs, length, finish=_text, schema="row long, doc_id long, text string, spans array<struct<start:long,stop:long>>", **named)
