import hashlib

import numpy as np
import pytest

from tessera.llm import suffix_dedup


def brute(rows, length):
    """All strings in a dictionary, in order."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        d, t = rows[i]
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((d is None, d or 0, len(raw), len(raw) - len(kept), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def unique(rows):
    """Rows with one row for each identifier: which of repeated rows is earlier is the scan's order."""
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("length", [100, 40])
def test_equals_brute_force(spark, rows, tmp_path, length):
    own = unique(rows)
    period = [(1001, "ab" * 300, None, None, 0), (1002, "x" * 250, None, None, 0), (1003, "x" * 99, None, None, 0), (1004, "x" * 100, None, None, 0), (999, "é" * 120 + "x" * 130, None, None, 0)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(own + period, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    assert found(suffix_dedup.summary(spark.read.parquet(path), length)) == brute([r[:2] for r in own + period], length)


def test_frequent_anchors(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 0.0)
    own = unique(rows)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    assert found(suffix_dedup.summary(spark.read.parquet(path), 60)) == brute([r[:2] for r in own], 60)


def test_work_in_steps_changes_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    data, sizes = rng.integers(97, 101, 5000).astype(np.uint8), np.array([1000, 30, 0, 2970, 1000])
    whole = suffix_dedup.pieces(data, sizes, 40, 11)
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    parts = suffix_dedup.pieces(data, sizes, 40, 11)
    spread = lambda p: [(int(f) + j, int(a)) for f, n, a in zip(p[0], p[1], p[2]) for j in range(n)]
    assert spread(whole) == spread(parts)
    assert len(spread(whole)) == sum(max(0, n - 39) for n in sizes)


def test_empty_table(empty):
    assert suffix_dedup.summary(empty).count() == 0


def test_text_that_is_left(docs):
    for r in suffix_dedup.deduplicate(docs).collect():
        assert sum(s.stop - s.start for s in r.spans) >= 0 and r.text is not None


def test_small_blocks_and_other_columns_change_nothing(spark, rows, tmp_path, monkeypatch):
    own = unique(rows)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(own, "doc_id long, text string, bucket string, row string, block long").repartition(3).write.parquet(path)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    assert found(suffix_dedup.summary(spark.read.parquet(path), 50)) == brute([r[:2] for r in own], 50)


def test_repeated_rows_keep_one_of_each(spark, tmp_path):
    text = "".join(chr(97 + x) for x in np.random.default_rng(2).integers(0, 26, 150))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(7, text)] * 4 + [(3, "z" + text), (None, text)], "doc_id long, text string").repartition(2).write.parquet(path)
    got = found(suffix_dedup.summary(spark.read.parquet(path)))
    assert [(x[0], x[1], x[3]) for x in got] == [(False, 3, 0)] + [(False, 7, 150)] * 4 + [(True, 0, 150)]


def test_frequent_sets_of_any_size():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    for n in (1, 100, 3000):
        often = suffix_dedup.Frequent(h[:n] * suffix_dedup._SPREAD)
        assert (often(h) == (np.arange(len(h)) < n)).all()
