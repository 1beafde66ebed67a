"""Edge lists: whitespace-separated text with comments, and Matrix Market coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(lines: DataFrame, comment: str, base: int) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    return rows.select((part[0].cast("long") - base).alias("src"), (part[1].cast("long") - base).alias("dst"))


def snap_edges(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(src, dst) of ``<from> <to>`` lines; lines with # and blank lines are skipped.

    A gzip file can't be split, so ``partitions`` spreads its rows after the scan.
    """
    out = _pairs(spark.read.text(path), "#", 0)
    return out.repartition(partitions) if partitions else out


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from 0 of a coordinate file; the first line after the comments holds the sizes and is skipped."""
    raw = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.col("value").startswith("%"))
    first = F.broadcast(raw.agg(F.min("at").alias("first")))  # one row
    return _pairs(raw.join(first).where("at <> first").select("value"), "%", 1)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file, or of the graph in a folder: the first Matrix Market file there or one folder down, else an edge list.

    In a folder files are told by .mtx, and .txt, .el, .tsv or .edges, each with .gz or without; a file that ends
    otherwise is an edge list. Raises ValueError where there is none.
    """
    if (kind := _kind(path)) is not None:
        return matrix_market(spark, path) if kind == 0 else snap_edges(spark, path)
    if _files(spark, path):
        return snap_edges(spark, path)
    found = _files(spark, f"{path}/*") + _files(spark, f"{path}/*/*")
    named = sorted((_kind(f), f) for f in found if _kind(f) is not None)
    if not named:
        raise ValueError(f"no graph file under {path}")
    return read_edges(spark, named[0][1])


def _files(spark: SparkSession, pattern: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in listed or [] if f.isFile()]


def _kind(path: str) -> int | None:
    name = path.removesuffix(".gz")
    return 0 if name.endswith(".mtx") else 1 if name.endswith((".txt", ".el", ".tsv", ".edges")) else None


def n_nodes(edges: DataFrame) -> DataFrame:
    """One row: the largest id plus one, 0 without edges."""
    return edges.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0)).alias("n"))
