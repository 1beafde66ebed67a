"""Incremental job: the link graph of a growing folder of web pages, as an edge table with the targets' degrees.

A file stream takes the files of ``input`` that came since the last run; ``checkpoint`` remembers them. Links are read
from the pages' HTML and resolved against their address. Writes, below ``output``:

* ``links/bucket=.../batch=.../``: page_id, src, dst, n; a row for each page and target, by bucket of the target's site
* ``targets/bucket=.../``: site, dst, n_links, degree (addresses that link there)
* ``layout/`` (JSON): the number of buckets; a run with another one is refused, as a target's links lie in one bucket

Each batch of new files replaces its own partitions of ``links``, then makes anew the ``targets`` of just those buckets
where it added links, from the edge table and never from the pages. Both steps give the same when a batch is run again, so
a failed run is mended by the next; a run without new files changes nothing. A page that is delivered twice counts as
two deliveries of one page: its links count once a target in ``degree`` and each time in ``n_links``.

    python jobs/link_graph.py --input .../pages --output /data/links --checkpoint /data/links-checkpoint
"""

from __future__ import annotations

import logging
import os
import sys
import uuid

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import below, command_line, counted, settings
from tessera.operators import graph

LOG = logging.getLogger("link_graph")
DEFAULTS = {"input": None, "output": None, "checkpoint": None, "buckets": 32, "files_a_batch": 1000}
PAGES = "page_id long, url string, html string"
LINKS = "page_id long, src string, dst string, n long, bucket int, batch long"
TARGETS = "site string, dst string, n_links long, degree long, bucket int"
#: Fixed value: the start of an absolute address, scheme and host.
SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def site(url: Column) -> Column:
    return F.regexp_extract(url, SITE, 0)


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, src, dst, n) of the pages' links: src is the address without query and fragment, dst the target without fragment.

    A target that starts with // takes the page's scheme, one that starts with / its site, any other relative one
    the site's root; targets of other schemes than http and https are left out, as are pages without address or HTML.
    """
    host, scheme = site(F.col("url")), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    href = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)'), 1))
    raw = pages.select("page_id", F.regexp_extract("url", r"^[^?#]*", 0).alias("src"), host.alias("host"), scheme.alias("scheme"), href.alias("h")).where("host <> ''")
    h = F.col("h")
    dst = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat("scheme", "h")).when(h.startswith("/"), F.concat("host", "h")).otherwise(F.concat(F.col("host"), F.lit("/"), h))
    return raw.select("page_id", "src", dst.alias("dst")).where(F.col("dst").rlike("^https?://[^/]")).groupBy("page_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def targets_of(links: DataFrame) -> DataFrame:
    """(site, dst, n_links, degree, bucket) of the edges' targets."""
    pairs = links.groupBy("bucket", "src", "dst").agg(F.sum("n").alias("n"))
    degree = graph.degrees(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("id", "dst")
    sums = pairs.groupBy("bucket", "dst").agg(F.sum("n").alias("n_links"))
    return sums.join(degree, "dst").select(site(F.col("dst")).alias("site"), "dst", "n_links", "degree", "bucket")


def _replace(df: DataFrame, path: str, by: list[str], order: list[str]) -> int:
    """Replace the partitions that ``df`` has rows of, in files cut by ``order``, so that none depends on one task."""
    rows, seen = counted(df.repartitionByRange(*order))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def _same_layout(spark: SparkSession, path: str, buckets: int) -> None:
    held = table(spark, path, "buckets long", "json").first()
    if held is None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(path)
    elif held.buckets != buckets:
        raise ValueError(f"{path} was made for {held.buckets} buckets, not {buckets}")


def table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that was written, or an empty one where nothing was yet."""
    try:
        return spark.read.format(kind).schema(schema).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def _pattern(path: str) -> str:
    """A pattern that matches just ``path``: the stream takes a pattern's match also where it is a single file."""
    path = path.rstrip("/")
    return path if any(x in path for x in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, config: dict) -> DataFrame:
    """The job; ends when the files there are have been taken. Returns the whole table of targets, read back."""
    c = settings(DEFAULTS, config)
    links_path, targets_path = below(c["output"], "links"), below(c["output"], "targets")
    _same_layout(spark, below(c["output"], "layout"), c["buckets"])

    def take(pages: DataFrame, batch: int) -> None:
        own = pages.sparkSession
        found = links_of(pages).withColumns({"bucket": F.pmod(F.xxhash64(site(F.col("dst"))), F.lit(c["buckets"])).cast("int"), "batch": F.lit(batch).cast("long")})
        n = _replace(found.select("page_id", "src", "dst", "n", "bucket", "batch"), links_path, ["bucket", "batch"], ["bucket", "dst", "page_id"])
        LOG.info("batch %d: read %d pages, wrote %d links", batch, pages.count(), n)
        if n:
            edges = own.read.schema(LINKS).parquet(links_path)
            touched = [r.bucket for r in edges.where(F.col("batch") == batch).select("bucket").distinct().collect()]  # as many as there are buckets at most
            m = _replace(targets_of(edges.where(F.col("bucket").isin(touched))), targets_path, ["bucket"], ["bucket", "dst"])
            LOG.info("batch %d: wrote %d targets of %d buckets", batch, m, len(touched))

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", c["files_a_batch"]).parquet(_pattern(c["input"]))
    query = stream.writeStream.queryName(f"link_graph_{uuid.uuid4().hex}").foreachBatch(take).option("checkpointLocation", c["checkpoint"]).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("took what was new in %s", c["input"])
    return table(spark, targets_path, TARGETS)


if __name__ == "__main__":
    command_line("link_graph", __doc__.splitlines()[0], DEFAULTS, run)
