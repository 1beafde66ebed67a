"""CSR folders by ranges: a data source whose partitions are parts of the files, and an export by position.

``offsets.bin`` and ``indices.bin`` hold little-endian int32, ``states.bin`` one int8 a node. Neither side needs a task that holds a
file: a reading task seeks its part and goes through it in chunks, a writing task puts its rows where they belong.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.graph import csr_offsets
from tessera.session import as_uri, checkpoint

#: Entries that a task reads at once.
CHUNK = 1 << 18
#: Entries of a partition, unless told otherwise: 16 MB of the file.
ROWS = 4_000_000
MOST = 2**31 - 1
SCHEMAS = {"edges": "src long, dst long", "nodes": "id long, state int, degree long"}


class Folder:
    """Files of a folder on any file system that pyarrow opens by its address."""

    def __init__(self, path: str):
        uri = as_uri(path)
        self.store, self.root = (pa.fs.LocalFileSystem(), uri[7:]) if uri.startswith("file://") else pa.fs.FileSystem.from_uri(uri)

    def length(self, name: str) -> int:
        """Bytes of a file; 0 where it is missing."""
        return self.store.get_file_info(f"{self.root}/{name}").size or 0

    def open(self, name: str):
        return self.store.open_input_file(f"{self.root}/{name}")


def _ints(f, at: int, n: int) -> np.ndarray:
    return np.frombuffer(f.read_at(4 * n, 4 * at), "<i4").astype(np.int64)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class CsrReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.table = options["path"], options.get("table", "edges")
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[Range]:
        """Ranges of edges or nodes. Files whose sizes don't fit together are refused here, before any task starts."""
        held = Folder(self.folder)
        size = held.length("offsets.bin")
        if size % 4 or size < 8:
            raise ValueError("offsets.bin is missing or too small")
        n = size // 4 - 1
        if self.table == "nodes":
            if (states := held.length("states.bin")) != n:
                raise ValueError(f"{states} states for {n} nodes")
            total = n
        else:
            with held.open("offsets.bin") as f:
                first, total = int(_ints(f, 0, 1)[0]), int(_ints(f, n, 1)[0])
            if first or not total or held.length("indices.bin") != 4 * total:
                raise ValueError("offsets and indices don't fit together")
        return [Range(i, min(i + self.rows, total)) for i in range(0, total, self.rows)]

    def read(self, partition: Range):
        held = Folder(self.folder)
        yield from (self._nodes if self.table == "nodes" else self._edges)(held, partition.low, partition.high)

    @staticmethod
    def _block(f, at: int, n: int) -> np.ndarray:
        offsets = _ints(f, at, n)
        if (np.diff(offsets) < 0).any():
            raise ValueError("offsets go down")
        return offsets

    def _edges(self, held: Folder, low: int, high: int):
        n = held.length("offsets.bin") // 4 - 1
        with held.open("offsets.bin") as offsets, held.open("indices.bin") as indices:
            a, b = 0, n  # the last node whose edges begin at or before ``low``
            while a < b:
                mid = (a + b + 1) // 2
                a, b = (mid, b) if _ints(offsets, mid, 1)[0] <= low else (a, mid - 1)
            node = a
            while low < high:
                if node >= n:
                    raise ValueError("offsets go down")
                starts = self._block(offsets, node, min(CHUNK, n - node) + 1)
                end = min(high, int(starts[-1]))
                while low < end:
                    top = min(low + CHUNK, end)
                    src = node + np.searchsorted(starts, np.arange(low, top), side="right") - 1
                    yield pa.record_batch([pa.array(src), pa.array(_ints(indices, low, top - low))], names=["src", "dst"])
                    low = top
                node += len(starts) - 1

    def _nodes(self, held: Folder, low: int, high: int):
        with held.open("offsets.bin") as offsets, held.open("states.bin") as states:
            for at in range(low, high, CHUNK):
                n = min(CHUNK, high - at)
                state = np.frombuffer(states.read_at(n, at), np.int8).astype(np.int32)
                yield pa.record_batch([pa.array(np.arange(at, at + n)), pa.array(state), pa.array(np.diff(self._block(offsets, at, n + 1)))], names=["id", "state", "degree"])


class CsrSource(DataSource):
    """``spark.read.format("csr").option("table", "edges" or "nodes").option("rows", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "edges")]

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))


def _read(spark: SparkSession, folder: str, table: str, rows: int) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").option("table", table).option("rows", rows).load(as_uri(folder))


def csr_binary(spark: SparkSession, folder: str, rows: int = ROWS) -> DataFrame:
    """(src, dst) of ``offsets.bin`` and ``indices.bin`` in ``folder``, at most ``rows`` of them a partition.

    Fails where the number of indices isn't the last offset, where there are none, or where offsets go down.
    """
    return _read(spark, folder, "edges", rows)


def csr_nodes(spark: SparkSession, folder: str, rows: int = ROWS) -> DataFrame:
    """(id, state, degree) of ``states.bin`` and ``offsets.bin``; fails unless there is one state a node.

    ``points.seed_by_state`` finds the seed of a walk among them.
    """
    return _read(spark, folder, "nodes", rows)


def _put(rows: DataFrame, path: str, kind: str, total: int) -> None:
    """The first column of ``rows``, in the order of its partitions, as one file that tasks fill side by side.

    A task that runs again writes the same bytes to the same place. The file gets its name when all is written.
    """
    rows = checkpoint(rows)
    counts = {r.p: r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    if at != total:
        raise ValueError(f"{at} rows for {total} places of {os.path.basename(path)}")
    width, part = np.dtype(kind).itemsize, f"{path}.part"

    def write(batches):
        done, place = 0, starts.get(TaskContext.get().partitionId(), 0)
        with open(part, "r+b") as f:
            f.seek(place * width)
            for pdf in batches:
                f.write(pdf.iloc[:, 0].to_numpy().astype(kind).tobytes())
                done += len(pdf)
        yield pd.DataFrame({"n": [done]})

    try:
        with open(part, "wb") as f:
            f.truncate(total * width)
        written = rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if written != total:
            raise ValueError(f"{written} of {total} rows written")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def export_csr(nodes: DataFrame, edges: DataFrame, folder: str, seed: int | None = None) -> None:
    """``states.bin`` (int8), ``offsets.bin`` and ``indices.bin`` (int32), for nodes 0..n-1.

    ``folder`` is a path that driver and tasks share. Edges are sorted by range and written by the tasks that hold
    them; one row a partition reaches the driver. Raises ValueError where ids aren't 0..n-1, where an edge starts at none of
    them, or beyond 2^31 - 1 edges, which the offsets can't hold; no file takes its name then.
    """
    ids = nodes.agg(F.count("id").alias("n"), F.count_distinct("id").alias("own"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if ids.n != ids.own or (ids.n and (ids.low, ids.high) != (0, ids.n - 1)):
        raise ValueError("node ids aren't 0..n-1")
    told = edges.agg(F.count("dst").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("src").alias("low"), F.max("src").alias("high")).first()
    if told.n > MOST:
        raise ValueError(f"{told.n} edges; offsets hold {MOST} at most")
    if told.n != told.rows or (told.n and (told.low < 0 or told.high >= ids.n)):
        raise ValueError("edges start outside of the nodes, or end nowhere")
    os.makedirs(folder, exist_ok=True)
    end = nodes.sparkSession.createDataFrame([(ids.n, told.n)], "id long, offset long")
    offsets = csr_offsets(edges, nodes).select(F.col("id").cast("long").alias("id"), "offset").unionByName(end)
    state = F.lit(0) if seed is None else (F.col("id") == seed).cast("int")
    _put(edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("dst"), f"{folder}/indices.bin", "<i4", told.n)
    _put(offsets.repartitionByRange("id").sortWithinPartitions("id").select("offset"), f"{folder}/offsets.bin", "<i4", ids.n + 1)
    _put(nodes.repartitionByRange("id").sortWithinPartitions("id").select(state.alias("state")), f"{folder}/states.bin", "i1", ids.n)
