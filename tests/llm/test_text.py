import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exchange, suffix_dedup, text

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\r\x0b\x0c\x1fé漢-.9 ", max_size=40)), max_size=8)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_tokens(texts):
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(t))] for t in texts]
    assert [text.space_tokens(t) for t in texts] == want
    h, n = text.token_hashes(texts)
    assert n.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(flat, h.tolist()))) == len(set(flat))
    words = [[w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))] for t in texts]
    assert [text.word_tokens(t) for t in texts] == words
    assert text.token_hashes(texts, text.WORDS)[1].tolist() == [len(w) for w in words]


def test_tokens_by_pieces_and_long_words():
    texts = ["ab " * 50, None, "x" * 500 + " " + "x" * 501 + " " + "x" * 63, "", "ab"]
    h, n = text.token_hashes(texts)
    g, m = text.token_hashes(texts, limit=20)
    assert (h == g).all() and (n == m).all() and n.tolist() == [50, 0, 3, 0, 1]
    assert len(set(h.tolist())) == 4 and h[0] == h[-1]


@given(st.lists(st.integers(0, 2**64 - 1), unique=True), st.lists(st.integers(0, 300)), st.lists(st.floats(allow_nan=False)))
@settings(max_examples=100, deadline=None)
def test_messages_come_back(keys, small, real):
    keys = np.sort(np.array(keys, np.uint64))
    got = exchange.unpack(exchange.pack({"sorted": keys, "small": np.array(small, np.int64), "real": np.array(real, np.float64)}))
    assert (got["sorted"] == keys).all() and got["small"].tolist() == small and got["real"].tolist() == real


@given(st.lists(st.integers(0, 2**64 - 1)), st.integers(1, 40))
def test_buckets_cover_all_keys(keys, buckets):
    keys = np.unique(np.array(keys, np.uint64))
    at = exchange.cut(keys, buckets)
    assert len(at) == buckets + 1 and at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()


@given(st.binary(max_size=300), st.integers(4, 12))
@settings(max_examples=100, deadline=None)
def test_equal_strings_have_equal_anchors(data, k):
    data = np.frombuffer(data + data[:60] + data, np.uint8)
    length = 3 * k
    first, strings, at, name = suffix_dedup.pieces(data, np.array([len(data)]), length, k)
    seen = {}
    for f, n, a, h in zip(first.tolist(), strings.tolist(), at.tolist(), name.tolist()):
        for i in range(f, f + n):
            assert i <= a <= i + length - k
            assert seen.setdefault(data[i : i + length].tobytes(), (a - i, h)) == (a - i, h)
    assert strings.sum() == max(0, len(data) - length + 1)


def test_frequent_anchors_are_avoided():
    data = np.random.default_rng(1).integers(0, 4, 2000).astype(np.uint8)
    *_, name = suffix_dedup.pieces(data, np.array([2000]), 40, 11)
    often = suffix_dedup.Frequent(name[:10])
    *_, other = suffix_dedup.pieces(data, np.array([2000]), 40, 11, often)
    assert not set(other.tolist()) & set(name[:10].tolist())


def _plans(docs):
    """The same rows by plans of several kinds."""
    n = docs.count()
    return {
        "moved": docs.repartition(5, "text"),
        "limit": docs.limit(n),
        "ordered limit": docs.orderBy("source", "lang").limit(n),
        "ordered": docs.orderBy("lang"),
        "rdd": docs.sparkSession.createDataFrame(docs.rdd.repartition(4), docs.schema),
        "drawn": docs.where(F.rand() < 0.999999),
        "joined": docs.join(docs.sparkSession.range(1).withColumnRenamed("id", "_one"), F.lit(True)).drop("_one"),
    }


def test_only_plans_of_scans_are_read_again(docs):
    from tessera.llm.exchange import steady

    half = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    for fixed in (docs, docs.select("doc_id", "text").where("doc_id > 3"), docs.where(half).unionByName(docs.where(~half))):
        assert steady(fixed) is fixed
    for kind, df in _plans(docs).items():
        written = steady(df)
        assert written is not df and steady(written) is written, kind


@pytest.mark.parametrize("kind", ["moved", "limit", "ordered limit", "rdd"])
def test_plans_that_move_rows_are_written_first(docs, kind):
    from tessera.llm import language_model, ngram_join, suffix_dedup

    moved = _plans(docs)[kind]
    key = lambda r: str(tuple(r))
    for f in (lambda d: language_model.evaluate(d).drop("score", "base_score"), lambda d: ngram_join.components(d).drop("row", "first"), lambda d: suffix_dedup.summary(d).select("doc_id", "n_bytes")):
        assert sorted(map(key, f(moved).collect())) == sorted(map(key, f(docs).collect()))
    assert len(ngram_join.keep_first(moved).collect()) == len(ngram_join.keep_first(docs).collect())
