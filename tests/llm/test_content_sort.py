import hashlib
from collections import defaultdict

from tessera.llm import content_sort


def brute(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d is None, d or 0, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str)


def test_equals_brute_force(docs, rows):
    got = content_sort.groups(docs)
    assert found(got) == brute(rows)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_a_group_over_many_partitions(spark, tmp_path):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"t{i % 7}") for i in range(50)] + [(5000 + i, "same tex") for i in range(3)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = content_sort.groups(spark.read.parquet(path))
        assert found(got) == brute(rows)
        assert got.where("kept").count() == 9
        left = content_sort.deduplicate(spark.read.parquet(path))
        assert sorted(r.doc_id for r in left.collect()) == sorted({max(d for d, t in rows if t == x) for x in {t for _, t in rows}})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chains_skip_empty_partitions():
    end = lambda pid, first, last, n=1: {"pid": pid, "first_run": 0, "last_run": last[0], "first_sha": first[1], "last_sha": last[1], "first_keep": first[2], "last_keep": last[2], "first_size": n, "last_size": n}
    ends = [end(0, (0, "a", 9), (3, "b", 8), 2), end(4, (0, "b", 7), (0, "b", 7), 5), end(6, (0, "b", 6), (1, "c", 5), 1)]
    assert content_sort._chains(ends) == [(0, 3, 8, 8, True), (4, 0, 8, 8, False), (6, 0, 8, 8, False)]


def test_own_columns_come_back(spark, docs, empty):
    odd = docs.withColumnsRenamed({"lang": "_t", "source": "keep", "n_chars": "pid"})
    assert content_sort.deduplicate(odd).columns == odd.columns
    assert content_sort.groups(odd).count() == odd.count()
    assert content_sort.groups(empty).count() == 0 and content_sort.deduplicate(empty).count() == 0
