"""Questions and answers between blocks of documents and buckets of keys.

Several operators need a fact about each n-gram (its count, its weight) at every place where the
n-gram stands. A join would move a row for every occurrence. Here each block of documents sends each
bucket one message with its distinct keys of that bucket, sorted, so a key that fills a third of the
corpus costs one entry a block; the bucket answers with one array in the same order. Messages are
binary columns of ordinary rows, moved by groupBy; nothing is gathered on the driver.

Blocks are cut inside scan partitions by bytes of text and named by partition and place, so a task
that is run again sends the same messages. That needs rows that come in the same order each time, as those of
a scan do; ``steady`` writes any other plan to a table first.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.session import saved

#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
MESSAGE = "kind int, bucket int, block long, payload binary"
_NAMES = ["kind", "bucket", "block", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def pack(arrays: dict) -> bytes:
    """Arrays as bytes: sorted 64-bit keys as differences, integers in their smallest type, all by byte planes."""
    out = {}
    for k, a in arrays.items():
        a = np.asarray(a)
        first = None
        if k.startswith("sorted") and len(a):
            first, a = int(a[0]), np.diff(a)
        elif a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.empty((0, 0), np.uint8)
        out[k] = (a.dtype.str, len(a), first, np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, n, first, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items():
        a = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T if n else np.empty((0, np.dtype(kind).itemsize), np.uint8)
        a = np.ascontiguousarray(a).view(kind).ravel()
        if first is not None:
            a = np.cumsum(np.r_[np.uint64(first), a.astype(np.uint64)], dtype=np.uint64)
        out[k] = a
    return out


def message(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([message(rows)])


def blocks(batches, text: int, limit: int = BLOCK_BYTES):
    """(block, list of columns as Python lists) of a scan partition.

    ``text`` is the column that is measured; the last one, which isn't handed on, is the number of the scan partition.
    """
    pid, n, held, size = 0, 0, None, 0
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[:-1]]
        if b.num_rows:
            pid = b.columns[-1][0].as_py()
        start = 0
        for i, t in enumerate(columns[text]):
            size += len(t or "")
            if size >= limit:
                cut = [c[start : i + 1] for c in columns]
                yield (pid << 24) + n, [a + b for a, b in zip(held, cut)] if held else cut
                held, size, start, n = None, 0, i + 1, n + 1
        rest = [c[start:] for c in columns]
        if rest[0]:
            held = [a + b for a, b in zip(held, rest)] if held else rest
    if held:
        yield (pid << 24) + n, held


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start in the sorted ``keys``; buckets are equal ranges of the hash."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(keys, edges), len(keys)]


def send(kind: int, block: int, buckets: int, keys: np.ndarray, **columns: np.ndarray):
    """Messages with the sorted keys of each bucket and what goes with them."""
    at = cut(keys, buckets)
    for b in range(buckets):
        lo, hi = at[b], at[b + 1]
        if hi > lo:
            yield kind, b, block, pack({"sorted": keys[lo:hi]} | {k: c[lo:hi] for k, c in columns.items()})


def received(group: pa.Table):
    """Messages in the order of (kind, bucket, block), unpacked one at a time."""
    rows = sorted(zip(*[group.column(k).to_pylist() for k in ("kind", "bucket", "block")], range(group.num_rows)))
    payload = group.column("payload")
    for kind, bucket, block, i in rows:
        yield kind, bucket, block, unpack(payload[i].as_py())


def answers(parts: list[tuple], kind: int) -> dict[str, np.ndarray]:
    """The answers of one kind, bucket after bucket: arrays in the order of the sorted keys that were asked."""
    own = [x for k, _, _, x in parts if k == kind]
    return {c: np.concatenate([x[c] for x in own]) for c in own[0]} if own else {}


#: Steps of a plan that give the same rows in the same partitions and order each time they run over the same files.
FIXED = ("Project", "Filter", "Union", "ColumnarToRow", "Scan parquet", "Scan orc", "Scan csv", "Scan json", "Scan text", "LocalTableScan")


def steady(df: DataFrame) -> DataFrame:
    """``df``, or a saved table of it unless its plan is made of file scans, projections, filters and unions only.

    Whatever moves, cuts or draws rows, or starts from another source, could give other rows in another order when it
    runs again: exchanges, limits, RDDs, functions that aren't deterministic.
    """
    plan = df._jdf.queryExecution()
    todo = [plan.sparkPlan()]
    fixed = plan.optimizedPlan().deterministic()
    while todo and fixed:
        step = todo.pop()
        fixed = step.nodeName().strip().startswith(FIXED)
        todo += [step.children().apply(i) for i in range(step.children().size())]
    return df if fixed else saved(df, "input")


def n_buckets(df: DataFrame) -> int:
    """About one bucket for each scan partition, so a bucket holds about what a block does."""
    return min(20_000, max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
