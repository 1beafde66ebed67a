import hashlib
import re

import pytest

from tessera.llm import decontaminate

BENCH = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window):
    out = []
    for d, t in rows:
        w = words(t)
        hit, names, n = set(), [], 0
        for item, x in items:
            v = words(x)
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            places = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams] if v else []
            if places:
                n += 1
                names += [] if item is None else [str(item)]
            for i in places:
                hit.update(range(i, i + k))
        out.append((d is None, d or 0, len(w), len(hit), n, hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def longest(rows, items, window):
    """Longest matches by comparing every two places."""
    out = []
    for d, t in rows:
        w, best = words(t), (0, (False, ""), 0)
        for item, x in items:
            v = words(x)
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] == v[j] and not (i and j and w[i - 1] == v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= min(window, len(v)):
                            best = min(best, (-n, (item is None, str(item or "")), i))
        out.append((d is None, d or 0, -best[0], None if not best[0] or best[1][0] else best[1][1], best[2] if best[0] else None))
    return sorted(out, key=str)


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.fixture(scope="module")
def bench(rows):
    texts = [t for _, t, *_ in rows if t]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    long = max(texts, key=len)
    return [(2, cut(long, 100, 30)), (10, cut(long, 5990, 12)), (1, cut(texts[0], 0, 10)), (3, cut(texts[4], 2, 3)), (4, "one"), (5, ""), (6, None), (None, cut(long, 200, 11)), (7, "ÉTÉ ça, l'ÉTÉ"), (7, "été 12"), (9, "never to be found in any of them at all here"), (11, cut(long, 0, 9) + " different")]


@pytest.mark.parametrize("window", [10, 3])
def test_equals_brute_force(spark, docs, rows, bench, window):
    b = spark.createDataFrame(bench, BENCH)
    assert found(decontaminate.score(docs, b, window=window)) == brute([r[:2] for r in rows], bench, window)


def test_slices_of_the_benchmark_change_nothing(spark, docs, rows, bench):
    b = spark.createDataFrame(bench, BENCH)
    assert found(decontaminate.score(docs, b, slice_bytes=60)) == brute([r[:2] for r in rows], bench, 10)


@pytest.mark.parametrize("slice_bytes", [decontaminate.SLICE_BYTES, 60])
def test_longest_match_equals_brute_force(spark, docs, rows, bench, slice_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_HITS", 5)
    b = spark.createDataFrame(bench, BENCH)
    got = decontaminate.score(docs.withColumnsRenamed({"lang": "item_id", "source": "key", "n_chars": "n_hit"}), b, slice_bytes=slice_bytes, carry=["key", "n_hit"])
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.longest_words, r.longest_item, r.longest_word) for r in got.collect()], key=str) == longest([r[:2] for r in rows], bench, 10)
    assert sorted(got.select("_c_n_hit").toPandas()["_c_n_hit"]) == sorted(r[4] for r in rows)


def test_small_blocks_change_nothing(docs, rows, bench):
    index = decontaminate.Index([(None if i is None else str(i), t) for i, t in bench])
    texts = [t for _, t, *_ in rows]
    counts, whole = decontaminate.find(index, texts)
    for i, t in enumerate(texts):
        n, own = decontaminate.find(index, [t])
        assert n[0] == counts[i] and {tuple(x[1:]) for x in own.tolist()} == {tuple(x[1:]) for x in whole.tolist() if x[0] == i}


def test_one_slice_of_the_benchmark_is_held_at_a_time(spark, docs, bench, monkeypatch):
    held, most, make = set(), [0], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        b = make(self, value)
        if isinstance(value, decontaminate.Index):
            held.add(id(b))
            most.append(len(held))
            drop = b.destroy
            b.destroy = lambda *a: (held.discard(id(b)), drop(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    decontaminate.score(docs, spark.createDataFrame(bench, BENCH), slice_bytes=60).count()
    assert len(most) > 5 and max(most) == 1


def test_longest_matches(spark, docs, bench):
    b = spark.createDataFrame(bench, BENCH)
    got = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.matches(docs, b).collect()}
    assert (65, "2", 100, 0, 30) in got and (66, "2", 100, 0, 30) in got


def test_removal_and_empty_tables(spark, docs, empty, rows, bench):
    b = spark.createDataFrame(bench, BENCH)
    left = decontaminate.remove(docs, b)
    assert left.columns == docs.columns
    assert left.count() == sum(not x[-1] for x in brute([r[:2] for r in rows], bench, 10))
    assert decontaminate.score(empty, b).count() == 0
    assert decontaminate.remove(docs, spark.createDataFrame([], BENCH)).count() == docs.count()
