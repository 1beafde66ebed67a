import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join


def sets(text, k):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return sorted(((d is None, d or 0), len(s[i]), (least[root(i)] is None, least[root(i)] or 0)) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, (r.component_id is None, r.component_id or 0)) for r in df.collect())


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 50)])
def test_equals_brute_force(docs, rows, words, percent):
    assert found(ngram_join.components(docs, words, percent)) == brute([r[:2] for r in rows], words, percent)


def test_large_neighbourhoods_are_cut_into_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_DOCS", 3)
    monkeypatch.setattr(ngram_join, "PART_DOCS", 2)
    assert found(ngram_join.components(docs, 4, 85)) == brute([r[:2] for r in rows], 4, 85)


@pytest.mark.parametrize("seed,task,part,shared", [(5, 4, 2, 0), (6, 10, 3, 1), (7, 30, 7, 4)])
def test_large_neighbourhoods_with_chains_of_copies(spark, tmp_path, monkeypatch, seed, task, part, shared):
    """Copies of copies drift apart, and one passage ties everything to one neighbourhood."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    passage, texts = say(9), []
    for _ in range(6):
        t = say(40) + passage
        for _ in range(rng.randint(3, 25)):
            texts.append(" ".join(t))
            if rng.random() < 0.7:
                t = list(t)
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, component long, `row` string").repartition(3).write.parquet(path)
    d = spark.read.parquet(path)
    want = brute(rows, 4, 70)
    assert found(ngram_join.components(d, 4, 70)) == want
    for k, v in (("TASK_DOCS", task), ("PART_DOCS", part), ("SHARED_DOCS", shared), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(ngram_join, k, v)
    assert found(ngram_join.components(d, 4, 70)) == want


@pytest.mark.parametrize("seed", range(4))
def test_connecting_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [np.sort(rng.choice(60, 20, replace=False)) for _ in range(4)]
    sets = []
    for _ in range(30):
        s = set(base[rng.integers(4)].tolist())
        for _ in range(rng.integers(0, 4)):
            s.symmetric_difference_update({int(rng.integers(60))})
        sets.append(np.array(sorted(s)))
    sizes = [len(s) for s in sets]
    before = rng.integers(0, 8, 30).tolist()
    own, ask = rng.random(30) < 0.7, rng.random(30) < 0.6
    for own_, ask_ in ((own, ask), (np.ones(30, bool), ask)):
        linked = lambda i, j: 100 * len(set(sets[i]) & set(sets[j])) >= 70 * len(set(sets[i]) | set(sets[j]))

        def parts(edges):
            up = list(range(30))
            for i, j in [(i, before.index(b)) for i, b in enumerate(before)] + edges:
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
            return {tuple(i for i in range(30) if up[i] == u) for u in set(up)}

        got = ngram_join.connect(sets, sizes, before, own_, ask_, 70)
        assert all(linked(i, j) for i, j in got)
        assert parts(got) == parts([(i, j) for i in np.flatnonzero(ask_).tolist() for j in np.flatnonzero(own_).tolist() if i != j and linked(i, j)])


def test_empty_table(empty):
    assert ngram_join.components(empty).count() == 0


def test_keep_first_has_one_row_of_each_group(docs, rows):
    kept = ngram_join.keep_first(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    groups = {}
    for d, _, c in brute([r[:2] for r in rows], 4, 85):
        groups.setdefault(c, []).append(d)
    ids = [r.doc_id for r in kept.collect()]
    texts = {t for _, t, *_ in rows}
    assert len(ids) >= len(groups) and texts
    assert {i for i in ids if i is not None} >= {c for n, c in groups if not n}


def test_bounds_are_whole_numbers():
    assert [ngram_join.least_overlap(n, 85) for n in (1, 20, 100, 101)] == [1, 17, 85, 86]
