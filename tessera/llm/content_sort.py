"""Exact dedup by content sort.

Splitters sampled by Spark's range partitioner cut the order (leading bytes, hash of the whole
text, identifier descending); Spark's external sort then places equal texts next to each other
and one pass compares each text in full with the one before it. The identifier is part of the
splitters, so a text that holds a third of all rows spreads over many partitions; runs that go
on in the next partition are joined from two digests a partition.

Defined results: a null text counts as empty; nothing is normalised; the largest identifier of
equal texts stays, null identifiers rank lowest; rows that repeat text and identifier form one
group in which one row stays. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import lean
from tessera.session import checkpoint, saved

#: Characters of the text in a splitter; the hash decides among texts with the same beginning.
PREFIX = 32


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` has _t, _id; equal _t become neighbours, largest _id first."""
    keyed = df.withColumns({"_p": F.substring("_t", 1, PREFIX), "_h": F.xxhash64("_t")})
    order = [F.col("_p"), F.col("_h"), F.col("_id").desc_nulls_last()]
    return keyed.repartitionByRange(*order).sortWithinPartitions("_p", "_h", "_t", F.col("_id").desc_nulls_last())


def _starts(texts: pa.Array, before: str | None) -> np.ndarray:
    """True where a text differs from the one before it."""
    n = len(texts)
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = ~np.asarray(pc.equal(texts.slice(1), texts.slice(0, n - 1)))
    if n and before is not None:
        out[0] = texts[0].as_py() != before
    return out


def _chains(ends: list) -> list[tuple]:
    """Runs that cross partitions: (pid, run, keep, size, is the chain's first part)."""
    out, chain = [], []

    def close():
        if len(chain) > 1:
            size = sum(c[3] for c in chain)
            out.extend((c[0], c[1], chain[0][2], size, i == 0) for i, c in enumerate(chain))

    digest = None
    for e in sorted(ends, key=lambda e: e["pid"]):
        first = (e["pid"], e["first_run"], e["first_keep"], e["first_size"])
        if chain and digest == e["first_sha"]:
            chain.append(first)
        else:
            close()
            chain = [first]
        if e["last_run"] != e["first_run"]:
            close()
            chain = [(e["pid"], e["last_run"], e["last_keep"], e["last_size"])]
        digest = e["last_sha"]
    close()
    return out


CHAIN = "pid int, run long, chain_keep long, chain_size long, chain_first boolean"


def _ends(t: DataFrame) -> list:
    """At most one row a partition, with digests and counts of its first and last run."""
    return t.groupBy("pid").agg(
        F.min("run").alias("first_run"), F.max("run").alias("last_run"),
        *[f(c, "run").alias(f"{side}_{c}") for side, f in (("first", F.min_by), ("last", F.max_by)) for c in ("sha", "keep", "size")],
    ).collect()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(doc_id).cast("long").alias("_id"))
    ready = _sorted(src).select("_t", "_id", F.sha2("_t", 256).alias("_s"))

    @lean

    def runs(batches):
        pid, run, before, held, sha = TaskContext.get().partitionId(), -1, None, [], None

        def rows():
            ids = pa.chunked_array(held).combine_chunks()
            n = len(ids)
            keep = pa.array([ids[0].as_py()] * n, pa.int64())
            first = np.zeros(n, bool)
            first[0] = True
            return pa.record_batch([ids, keep, pa.array(np.full(n, n, np.int64)), pa.array(first), pa.array([sha] * n, pa.string()), pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, run, np.int64))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            at = np.flatnonzero(_starts(b.column(0), before))
            before = b.column(0)[b.num_rows - 1].as_py()
            whole = at[:-1] if len(at) else at
            head = at[0] if len(at) else b.num_rows
            if head:
                held.append(b.column(1).slice(0, head))
            if len(at):
                if held:
                    yield rows()
                # runs that begin and end inside this batch
                sizes = np.diff(at)
                if len(whole):
                    lo, hi = int(at[0]), int(at[-1])
                    ids = b.column(1).slice(lo, hi - lo)
                    starts = np.repeat(whole, sizes)
                    first = np.zeros(hi - lo, bool)
                    first[whole - lo] = True
                    yield pa.record_batch([ids, b.column(1).take(pa.array(starts)), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(first), b.column(2).slice(lo, hi - lo), pa.array(np.full(hi - lo, pid, np.int32)), pa.array(np.repeat(run + 1 + np.arange(len(sizes)), sizes).astype(np.int64))], names=names)
                run += len(at)
                held, sha = [b.column(1).slice(int(at[-1]))], b.column(2)[int(at[-1])].as_py()
        if held:
            yield rows()

    schema = "id long, keep long, size long, first boolean, sha string, pid int, run long"
    names = [f.split()[0] for f in schema.split(", ")]
    marked = checkpoint(ready.mapInArrow(runs, schema))
    chains = spark.createDataFrame(_chains(_ends(marked)), CHAIN)  # two rows a partition at most
    out = marked.join(F.broadcast(chains), ["pid", "run"], "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("chain_size").isNotNull(), F.col("chain_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("chain_first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    spark, names = docs.sparkSession, docs.columns
    carried = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_t"), docs[doc_id].cast("long").alias("_id"))
    ready = _sorted(carried).select("_row", "_t", "_id", F.sha2("_t", 256).alias("_s"))

    @lean

    def heads(batches):
        pid, run, before = TaskContext.get().partitionId(), -1, None
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1)
            at = np.flatnonzero(_starts(texts, before))
            before = texts[b.num_rows - 1].as_py()
            if len(at):
                keep = pa.array(at)
                n = len(at)
                yield pa.record_batch([b.column(0).take(keep), b.column(2).take(keep), b.column(3).take(keep), pa.array(np.full(n, 1, np.int64)), pa.array(np.full(n, pid, np.int32)), pa.array((run + 1 + np.arange(n)).astype(np.int64))], names=fields)
                run += n

    schema = T.StructType([carried.schema["_row"], *T._parse_datatype_string("keep long, sha string, size long, pid int, run long").fields])
    fields = [f.name for f in schema]
    first = saved(ready.mapInArrow(heads, schema), "content-sort")
    chains = spark.createDataFrame(_chains(_ends(first)), CHAIN)
    out = first.join(F.broadcast(chains), ["pid", "run"], "left").where(F.coalesce("chain_first", F.lit(True)))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
