"""From raw documents to a training mix, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read
again as the next stage's ``docs``. A stage works on all rows that its predecessor kept; all but the
last return the columns of ``documents``, the last adds what the mix takes.

1. quality: documents that the classifier rejects go.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_duplicates: of each group linked by five-word shingles (similarity 0.8 or more) the smallest doc_id stays.
4. decontaminate: documents with a window of a benchmark item go.
5. mixing: documents are chosen so that the sources come near their targets; ``taken`` is the number of
   words that the mix takes, repeats counted.

Nulls, empty texts and repeated rows are treated as the operators define them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import content_sort, decontaminate, mixing, ngram_join, quality
from tessera.session import remove, scratch, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    mixed = mixing.mix(docs, carry=names).where(F.col("taken") > 0)
    return mixed.select(*[F.col(f"_c_{c}").alias(c) for c in names], "taken")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and the seeded choice can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again.

    Once a stage is written, what it saved on the way and its predecessor's table go; tables of others stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove(spark, before)
        before = path
    return docs
