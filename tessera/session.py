"""Session helpers shared by the library, the entry module and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession, root: str) -> None:
    """Let Python workers import this package from ``root``, wherever they start."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where that setting is absent, as in local tests.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-ckpt-")
        named = _LOCAL[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def as_uri(path: str) -> str:
    """``path`` with a scheme; a local path gets ``file://``."""
    if m := re.match(r"file:/*(?=/)", path):
        return "file://" + path[m.end() :].rstrip("/")
    return path.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) else "file://" + os.path.abspath(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


#: Removes the shuffle files of a plan once it has been run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: How many writes of a session hold CLEANUP, and what it was before the first of them.
_HELD: dict[str, tuple[int, str]] = {}
#: The tables saved within the innermost ``scratch`` of this thread.
_OWN: ContextVar[list[str] | None] = ContextVar("saved tables", default=None)


@contextmanager
def _cleaning(spark: SparkSession):
    """CLEANUP is on within; the last of several threads to leave puts back what there was before the first."""
    key = str(spark._jsparkSession.sessionUUID())
    with _LOCK:
        n, before = _HELD.get(key, (0, spark.conf.get(CLEANUP, "false")))
        _HELD[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _HELD.pop(key)
            if n > 1:
                _HELD[key] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder; the table that was written, and its path.

    The table goes when the driver ends, or by ``remove``; the shuffle files of ``df`` go at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table of ``stored``; it goes at the end of the ``scratch`` around it, if there is one."""
    out, path = stored(df, name)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread saves within go at its end, and no others; other threads may save meanwhile."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        for path in own:
            remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, path: str) -> None:
    """Note that ``path`` may go when the driver ends."""
    at, store = _file_system(spark, path)
    store.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that was stored; nothing may read it any more."""
    at, store = _file_system(spark, path)
    store.delete(at, True)
