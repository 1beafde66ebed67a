import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = [lambda: " ".join(word() + "%%%" for _ in range(40)), lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: (word() + " ") * 50]
    rows, labels = [], []
    for i in range(400):
        y = int(i % 4 != 0)
        rows.append((i, good() if y else bad[i % 3](), "en", "s", 0))
        labels.append((i, y, 0))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (None, good(), None, None, 0), (1002, "y" * 400_000, None, None, 0), (3, rows[3][1], "en", "s", 0)]
    labels += [(5, 1, 0), (7, None, 0), (None, 1, 0), (1000, 0, 0), (99999, 1, 0)]
    path = str(tmp_path_factory.mktemp("quality") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, int(r.doc_id % 4 != 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95


def test_runs_agree_and_columns_come_back(tables):
    docs, labels, _ = tables
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.classify(docs, labels).collect()) for _ in range(2))
    assert a == b
    odd = docs.withColumnsRenamed({"lang": "_t", "source": "score", "n_chars": "y"})
    kept = quality.accept(odd, labels)
    assert kept.columns == odd.columns and 250 < kept.count() < 350


def test_one_class_or_none(spark, tables, empty):
    docs, labels, _ = tables
    only = quality.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in only}) == 1 and only[0].score > 0.99
    assert {r.score for r in quality.classify(docs, labels.where("quality > 1")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def plain_features(text):
    """Words, pairs, equal pairs and n-grams of a text, one by one."""
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    out = [("word", x) for x in w] + [("pair", *x) for x in zip(w, w[1:])] + [("same",) for x in zip(w, w[1:]) if x[0] == x[1]]
    for x in w:
        x = f" {x} "
        out += [("gram", n, x[i : i + n]) for n in quality.NGRAMS for i in range(len(x) - n + 1)]
    return out


def test_features_equal_plain_ones():
    texts = [None, "", "  ", "a", "a a\ta", "the cat sat on the mat mat", "été été 日本語 x" * 3, "word " * 40, "\U0001f600\U0001f600 \U0001f600"]
    bucket, row = quality.features(texts)
    known = {}
    for i, t in enumerate(texts):
        own = sorted(bucket[row == i].tolist())
        assert own == sorted(quality.features([t])[0].tolist())
        want = Counter(plain_features(t))
        assert len(own) == sum(want.values())
        assert sorted(Counter(own).values()) == sorted(want.values())
        known[i] = want
    a, b = (Counter(bucket[row == i].tolist()) for i in (3, 4))
    assert sum((a & b).values()) == sum((known[3] & known[4]).values())
