"""The ledger of a walk as a stream: append-only JSON lines, read as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.walks import first_flip

LEDGER = "f long, n long, s byte, t byte, g double, a int, ns long"


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LEDGER).json(folder)


def first_flips(spark: SparkSession, folder: str) -> DataFrame:
    """First frame in which each node turned; state is one row a node."""
    return first_flip(ledger_stream(spark, folder))
