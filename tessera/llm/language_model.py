"""Language-model scoring: a Katz backoff model of any order with Good-Turing discounts.

Tokens are whitespace-separated words in lower case, then one end; before the first token stands a
start mark, and histories go back to it at most. Counts of words and n-grams up to the order come from all
learning rows. P(w) is the discounted count of w over all, and what the discounts leave goes to one
unknown word, so the unigram distribution sums to one over the vocabulary and the unknown word. P(w | h)
is the discounted count of (h, w) over that of h where the n-gram was seen, else alpha(h) P(w | h') with
h' the history without its first token; alpha(h) is what the discounts leave over what the unseen words
hold, so each history's distribution sums to one at every order. A history that was never seen has
alpha 1. One whose counts are all too large to be discounted gets one more in its denominator, which
leaves mass.

Counts and backoff weights are tables partitioned by hash ranges of their keys; blocks of documents
ask them for what their distinct n-grams and histories need (see ``exchange``). The words seen after a
history h were all seen after h' too, where they have discounted counts over one denominator; so sums of
counts make the weights of all orders in one round, and the blocks divide. Every token is then scored
by recursion through the orders.

Defined results: a null or empty text is one end token. Without learning rows every token is the
unknown word with probability 1, so scores are 0. Discounts that the counts of counts can't give
(empty or rising) fall back to absolute discounting, ``_discounts``. Repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import MESSAGE, answers, blocks, message, n_buckets, pack, received, send, steady, table, unpack
from tessera.llm.text import lean, mix64, remainder, token_hashes
from tessera.session import saved

#: Counts above this are taken as they are.
K = 5
#: Hashes of the end and the start mark; the start sorts after all tokens.
END, START = np.uint64(2**64 - 2), np.uint64(2**64 - 1)
ORDER = 3
#: Kinds of messages: n-grams go by their order, histories by that and HISTORY, texts by TEXTS.
HISTORY, TEXTS = 100, 999
BLOCK_BYTES = 8 << 20


def _discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount ratios d[0..K] from the counts of counts n[1..K+1]; d[r] in (0, 1)."""
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = [1.0]
    for r in range(1, K + 1):
        d = (((r + 1) * n[r + 1] / (r * n[r])) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return np.array(out)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of the value at every place."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], order[new], back


class Block:
    """Tokens of a block of documents by number, and its distinct n-grams by order."""

    def __init__(self, texts: list[str | None], held: list[bool]):
        tokens, n = token_hashes(texts)
        self.sizes = n + 1
        flat = np.full(int(self.sizes.sum()), END, np.uint64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        flat[inner] = tokens
        keys, some, words = _distinct(flat)
        self._finish(keys, some, words, np.array(held, bool))

    def _finish(self, keys: np.ndarray, some: np.ndarray | None, words: np.ndarray, held: np.ndarray) -> None:
        self.text_held, self.held = held, np.repeat(held, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(words), dtype=np.int32) - np.repeat(self.first, self.sizes).astype(np.int32)
        #: By order: distinct hashes, a token of each, the number at every token (-1 where the history would pass the start).
        self.grams = {1: (keys, some, words)}
        self.last = self.hash = keys[words]

    def columns(self) -> dict:
        keys, _, words = self.grams[1]
        return {"words": words, "sizes": self.sizes, "held": self.text_held.astype(np.uint8), "sorted": keys}

    @classmethod
    def load(cls, x: dict) -> Block:
        b = cls.__new__(cls)
        b.sizes = x["sizes"].astype(np.int64)
        b._finish(x["sorted"], None, x["words"].astype(np.int32), x["held"].astype(bool))
        return b

    def order(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of order ``m``: the tokens whose history reaches back m - 1 places, the start mark included."""
        if m not in self.grams:
            self.order(m - 1)
            before = np.empty_like(self.last)
            before[1:] = self.last[:-1]
            if m == 2:
                before[self.first] = START
            self.last = mix64(before * np.uint64(0x9E3779B97F4A7C15) + self.hash)
            if m == 2:
                self.grams[m] = _distinct(self.last)
                return self.grams[m]
            own = np.flatnonzero(self.place >= m - 2)
            keys, some, back = _distinct(self.last[own])
            at = np.full(len(self.last), -1, np.int32)
            at[own] = back
            self.grams[m] = keys, own[some], at
        return self.grams[m]

    def histories(self, m: int) -> np.ndarray:
        """Number of each token's history among the n-grams of order m - 1; the start mark comes after all words."""
        keys, _, at = self.grams[m - 1]
        out = np.empty_like(at)
        out[1:] = at[:-1]
        out[self.first] = len(keys) if m == 2 else -1
        return out


def _count(group: pa.Table) -> pa.Table:
    """Counts of the keys of a bucket, back to every block; the first block that learns an n-gram owns it."""
    parts = list(received(group))
    keys = np.concatenate([x["sorted"] for *_, x in parts])
    n = np.concatenate([x["n"] for *_, x in parts]).astype(np.int64)
    u, _, back = _distinct(keys)
    total = np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)
    seen = np.flatnonzero(n > 0)[::-1]
    owner = np.zeros(len(n), bool)
    first = np.full(len(u), -1)
    first[back[seen]] = seen
    owner[first[first >= 0]] = True
    rows, lo = [], 0
    for kind, bucket, block, x in parts:
        hi = lo + len(x["sorted"])
        rows.append((kind, bucket, block, pack({"n": total[back[lo:hi]], "own": owner[lo:hi].astype(np.uint8)})))
        lo = hi
    kind, bucket = parts[0][:2]
    of = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    rows.append((kind, bucket, -1, pack({"of": of, "sum": np.array([total.sum(), (total > 0).sum()])})))
    return table(rows)


def _by_count(key: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """How many of the counts ``n`` of each key are 1, 2 and so on to K."""
    small = n <= K
    return np.bincount(key[small] * K + n[small] - 1, minlength=length * K).reshape(length, K)


#: What the n-grams after a history add to its sums, in whole numbers: their counts of counts to K, those of the order below, and the sum of larger ones.
SUMS = [*[f"own{r}" for r in range(1, K + 1)], *[f"below{r}" for r in range(1, K + 1)], "large"]


def _weigher(model: Model):
    """Sums over what was seen after a bucket's histories: whether nothing was discounted, and where it is asked for the mass left and ``below``."""

    def weigh(group: pa.Table) -> pa.Table:
        parts = list(received(group))
        m = parts[0][0] - HISTORY
        column = lambda c: np.concatenate([x[c] for *_, x in parts])
        u, _, back = _distinct(column("sorted"))
        total = lambda c: np.bincount(back, weights=column(c), minlength=len(u))
        small = np.arange(1, K + 1)
        lost = sum(total(f"own{r}") * x for r, x in zip(small, small * (1 - model.discounts[m][1:])))
        below = total("large") + sum(total(f"below{r}") * x for r, x in zip(small, small * model.discounts[m - 1][1:]))
        more = lost == 0
        rows, lo = [], 0
        for kind, bucket, block, x in parts:
            own = back[lo : lo + len(x["sorted"])]
            need = own[x["need"].astype(bool)]
            rows.append((kind, bucket, block, pack({"more": more[own].astype(np.uint8), "mass": (lost + more)[need], "below": below[need]})))
            lo += len(own)
        return table(rows)

    return lean(weigh)


class Model:
    """Discounts by order, and the sizes that the unigram distribution needs."""

    def __init__(self, of: dict[int, list[int]], total: int, kinds: int, starts: int):
        self.total, self.kinds, self.starts = total, kinds, starts
        self.discounts = {m: _discounts(x) for m, x in of.items()}
        small = sum(r * of[1][r] for r in range(1, K + 1))
        kept = sum(self.discounts[1][r] * r * of[1][r] for r in range(1, K + 1)) + total - small
        self.whole = total if total - kept > 1e-9 * max(1, total) else total + 1
        self.unknown = (self.whole - kept) / self.whole if total else 1.0

    def discounted(self, n: np.ndarray, m: int) -> np.ndarray:
        return n * np.where(n <= K, self.discounts[m][np.minimum(n, K)], 1.0)

    def words(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.discounted(n, 1) / max(1, self.whole), self.unknown)


class Opened:
    """A block with the answers it got, and the probabilities of its tokens by recursion through the orders."""

    def __init__(self, group: pa.Table, model: Model):
        self.parts, self.model = list(received(group)), model
        self.texts = next(x for k, _, _, x in self.parts if k == TEXTS)
        self.block, self.held = Block.load(self.texts), {}

    def counts(self, m: int) -> np.ndarray:
        """Counts of the block's n-grams of order ``m``; of the words, then of the start mark."""
        if m not in self.held:
            n = answers(self.parts, m)["n"].astype(np.int64)
            self.held[m] = np.r_[n, self.model.starts] if m == 1 else n
        return self.held[m]

    def asked(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the seen histories of order ``m`` in the block, and which of them have an unseen token."""
        _, _, at = self.block.order(m)
        h, n = self.block.histories(m), self.counts(m - 1)
        own = np.flatnonzero(at >= 0)
        there, need = np.zeros(len(n), bool), np.zeros(len(n), bool)
        there[h[own]] = True
        there &= n > 0
        need[h[own[self.counts(m)[at[own]] == 0]]] = True
        asked = np.flatnonzero(there)
        return asked, need[asked]

    def sums(self, m: int) -> tuple[np.ndarray, dict]:
        """Numbers of the histories to ask about; what the block's own n-grams add to their sums, and which of them have an unseen token."""
        _, some, _ = self.block.order(m)
        got = answers(self.parts, m)
        own = got["own"].astype(bool)
        first, r = some[own], got["n"][own].astype(np.int64)
        h, n = self.block.histories(m)[first], self.counts(m - 1)
        lower = n[self.block.grams[m - 1][2][first]]
        asked, need = self.asked(m)
        place = np.zeros(len(n), np.int64)
        place[asked] = np.arange(len(asked))
        key, large = place[h], np.where(lower > K, lower, 0)
        columns = [*_by_count(key, r, len(asked)).T, *_by_count(key, lower, len(asked)).T, np.bincount(key, weights=large, minlength=len(asked)).astype(np.int64)]
        return asked, dict(zip(SUMS, columns)) | {"need": need.astype(np.uint8)}

    def probabilities(self, order: int) -> np.ndarray:
        """P of every token with the histories of the order."""
        p = self.model.words(self.counts(1)[self.block.grams[1][2]])
        under = np.full(len(p), float(max(1, self.model.whole)))  # denominator at the order before
        for m in range(2, order + 1):
            _, _, at = self.block.order(m)
            asked, need = self.asked(m)
            got, n = answers(self.parts, HISTORY + m), self.counts(m - 1)
            full, mass, below = n.astype(float), np.zeros(len(n)), np.zeros(len(n))
            if len(asked):
                full[asked] += got["more"]
                mass[asked[need]], below[asked[need]] = got["mass"], got["below"]
            own = np.flatnonzero(at >= 0)
            h, r = self.block.histories(m)[own], self.counts(m)[at[own]]
            whole = full[h]
            new = p[own]
            seen = r > 0
            new[seen] = self.model.discounted(r[seen], m) / whole[seen]
            back = np.flatnonzero(~seen & (n[h] > 0))
            new[back] *= mass[h[back]] / whole[back] / np.maximum(1 - below[h[back]] / under[own[back]], 1e-300)
            p[own], under[own] = new, np.maximum(whole, 1)
        return p


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; n-grams have up to ``order`` tokens."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    src = steady(docs.select(docs[doc_id].cast("long").alias("i"), docs[text].alias("t"), F.coalesce(held_out, F.lit(False)).alias("h")))
    # every learning text is counted as a history by its start
    starts = src.where("not h").count()
    src, buckets, orders = src.withColumn("p", F.spark_partition_id()), n_buckets(src), range(1, order + 1)

    @lean
    def ask(batches):
        for block, (_, texts, held) in blocks(batches, 1, BLOCK_BYTES):
            b = Block(texts, held)
            for m in orders:
                keys, _, at = b.order(m)
                learnt = at[~b.held & (at >= 0)]
                yield message(list(send(m, block, buckets, keys, n=np.bincount(learnt, minlength=len(keys)))))

    counts = saved(src.mapInArrow(ask, MESSAGE).groupBy("kind", "bucket").applyInArrow(lean(_count), MESSAGE), "lm-counts")
    of, total, kinds = {m: [0] * (K + 3) for m in orders}, 0, 0
    for r in counts.where("block = -1").toLocalIterator():  # a few numbers a bucket
        x = unpack(bytes(r.payload))
        of[r.kind] = [a + int(b) for a, b in zip(of[r.kind], x["of"])]
        if r.kind == 1:
            total, kinds = total + int(x["sum"][0]), kinds + int(x["sum"][1])
    model = Model(of, total, kinds, starts)

    @lean
    def texts(batches):
        for block, (ids, t, held) in blocks(batches, 1, BLOCK_BYTES):
            null = np.array([i is None for i in ids], np.uint8)
            yield message([(TEXTS, 0, block, pack(Block(t, held).columns() | {"null": null, "id": np.array([i or 0 for i in ids], np.int64)}))])

    @lean
    def gather(group: pa.Table) -> pa.Table:
        o, rows = Opened(group, model), []
        for m in orders[1:]:
            asked, sums = o.sums(m)
            keys = o.block.grams[m - 1][0]
            keys = np.r_[keys, START] if m == 2 else keys
            rows += send(HISTORY + m, group.column("block")[0].as_py(), buckets, keys[asked], **sums)
        return table(rows)

    asked = src.mapInArrow(texts, MESSAGE)
    known = counts.where("block >= 0")
    if order > 1:
        sums = asked.unionByName(known).groupBy("block").applyInArrow(gather, MESSAGE)
        known = known.unionByName(saved(sums.groupBy("kind", "bucket").applyInArrow(_weigher(model), MESSAGE), "lm-weights"))

    @lean
    def judge(group: pa.Table) -> pa.Table:
        o = Opened(group, model)
        p, n, sizes = o.probabilities(order), o.counts(1)[o.block.grams[1][2]], o.block.sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda a: np.bincount(doc, weights=a, minlength=len(sizes))
        base = sums(np.log10((n + 1) / (total + kinds + 1)))
        return pa.table([
            pa.array(o.texts["id"].astype(np.int64), mask=o.texts["null"].astype(bool)), pa.array(o.block.text_held), pa.array(sizes), pa.array(sums(n > 0).astype(np.int64)),
            pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(sums(np.log10(p))),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return asked.unionByName(known).groupBy("block").applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def evaluate(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER) -> DataFrame:
    """Scores of all rows; rows of the held-out fold teach nothing."""
    return score(docs, remainder(docs["doc_id"], folds) == fold, order=order)
