import os

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, ngram_join

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "decontaminate", "mixing"]


def test_stages_hold_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    first, good, single, apart, clean, mixed = [x.collect() for x in kept]
    assert all(x.columns == columns for x in kept[:-1]) and kept[-1].columns == [*columns, "taken"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in first} - {r.doc_id for r in good}
    assert gone and not [d for d in gone if labels.get(d) == 1]
    best = {}
    for r in good:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values())
    from tests.llm.test_ngram_join import brute

    groups = {}
    for d, _, c in brute([(r.doc_id, r.text) for r in single], 5, 80):
        groups.setdefault(c, []).append(d[1])
    assert {r.doc_id for r in apart} == {min(g) for g in groups.values()}
    from tests.llm.test_decontaminate import brute as dirty

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {x[1] for x in dirty([(r.doc_id, r.text) for r in apart], items, decontaminate.WINDOW) if not x[-1]}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and all(0 < r.taken <= 3 * len(r.text.split()) for r in mixed)
    assert ngram_join.PERCENT == 80 and ngram_join.WORDS == 5


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[-1] == "taken" and got.count() > 0


def test_an_empty_table_stays_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_odd_rows_and_columns_pass_every_stage(spark, docs, tmp_path):
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "lang as row", "n_chars as score", "text as _t", "doc_id as id", "source as p", "lang as pattern", "n_chars as taken_before")
    odd.write.parquet(str(tmp_path / "in"))
    at = spark.read.parquet(str(tmp_path / "in"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        assert out.columns[: len(odd.columns)] == odd.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    assert at.where("_t is distinct from text or id is distinct from doc_id").count() == 0
