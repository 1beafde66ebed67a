import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import language_model as lm
from tessera.llm.text import remainder


def tokens(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def brute(rows, order=3):
    """The model with plain dictionaries, recursively."""
    grams, after, starts = [Counter() for _ in range(order + 1)], [defaultdict(dict) for _ in range(order + 1)], 0
    for d, t in rows:
        if not held(d):
            seq = ["<s>", *tokens(t)]
            starts += 1
            for i in range(1, len(seq)):
                for m in range(1, min(order, i + 1) + 1):
                    grams[m][tuple(seq[i - m + 1 : i + 1])] += 1
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[m][g[:-1]][g[-1]] = c
    words = Counter({g[0]: c for g, c in grams[1].items()})
    n, v = sum(words.values()), len(words)
    of = lambda c: [0] + [sum(1 for x in c.values() if x == r) for r in range(1, lm.K + 2)]
    ratio = [None] + [lm._discounts(of(c)) for c in grams[1:]]
    cut = lambda c, d: c * (d[c] if c <= lm.K else 1.0)
    kept = sum(cut(c, ratio[1]) for c in words.values())
    whole = n if n - kept > 1e-9 * max(1, n) else n + 1

    @cache
    def left(h):
        """Denominator and backoff weight of a seen history."""
        seen = after[len(h) + 1][h]
        total, mass = sum(seen.values()), sum(cut(c, ratio[len(h) + 1]) for c in seen.values())
        full = total if total - mass > 1e-9 * total else total + 1
        return full, (full - mass) / full / (1 - sum(p(h[1:], x) for x in seen))

    @cache
    def p(h, w):
        if not h:
            return cut(words[w], ratio[1]) / whole if words[w] else (whole - kept) / whole
        seen = after[len(h) + 1].get(h)
        if not seen:
            return p(h[1:], w)
        full, alpha = left(h)
        return cut(seen[w], ratio[len(h) + 1]) / full if w in seen else alpha * p(h[1:], w)

    out = {}
    for i, (d, t) in enumerate(rows):
        seq = ["<s>", *tokens(t)]
        score = sum(math.log10(p(tuple(seq[max(0, j - order + 1) : j]), seq[j])) for j in range(1, len(seq)))
        out[i] = (d, held(d), len(seq) - 1, sum(words[w] > 0 for w in seq[1:]), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in seq[1:]), score)
    return out, p, words, after


def key(r):
    return (r[0] is None, r[0] or 0, r[1:5], round(r[5], 6))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(docs, rows, order):
    want = sorted(brute([r[:2] for r in rows], order)[0].values(), key=key)
    got = sorted((tuple(r) for r in lm.evaluate(docs, order=order).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_small_blocks_and_other_columns_change_nothing(docs, rows, monkeypatch):
    want = sorted((tuple(r) for r in lm.evaluate(docs).collect()), key=key)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    odd = docs.withColumnsRenamed({"lang": "h", "source": "p", "n_chars": "block"}).withColumn("kind", F.lit(1))
    got = sorted((tuple(r) for r in lm.evaluate(odd).collect()), key=key)
    assert len(got) == len(want) and all(a[:5] == b[:5] and math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(got, want))


def test_distributions_sum_to_one(rows):
    _, p, words, after = brute([r[:2] for r in rows])
    for m in (2, 3):
        for h in list(after[m])[:30]:
            assert math.isclose(sum(p(h, w) for w in words) + p(h, "never seen"), 1, rel_tol=1e-9)


def test_the_order_is_checked(docs):
    with pytest.raises(ValueError):
        lm.evaluate(docs, order=0)


def test_nothing_to_learn(docs, empty):
    assert lm.evaluate(empty).count() == 0
    assert {r.score for r in lm.score(docs, F.lit(True)).collect()} == {0.0}


def test_remainder_is_crc32_of_the_decimal_text(docs):
    for r in docs.select("doc_id", remainder(docs["doc_id"], 7).alias("m")).collect():
        assert r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7
