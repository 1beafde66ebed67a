"""Quality classifier: supervised subword embeddings.

Every text becomes the average of learned vectors of its features: words, pairs of neighbouring words
and n-grams of the characters of words, each hashed to a bucket. A softmax layer on the average gives the classes. Vectors
and layer are trained together by numpy stochastic gradient descent on a bounded sample of labelled
rows (``SAMPLE`` rows of each class, those with the smallest hash of the identifier). As the layer is
linear, a bucket's vector and the layer fold into one number a bucket for scoring, so what is
broadcast has ``BUCKETS`` numbers whatever the input.

Defined results: null and empty texts have no features and get the softmax of the layer's bias.
Labels that are null or of documents without text teach nothing; of repeated labels of one document
the larger counts; repeated documents teach once for each row. Other columns are ignored. Where no row, or only one class, can be learned, the score is the share of label 1
among the labels, or 0.5 without labels. Scoring reads the text only and works row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lean, pieces, release, remainder

BUCKETS, DIMENSIONS = 1 << 17, 8
NGRAMS = (3, 4)
SAMPLE = 1500
EPOCHS, RATE, BATCH, SEED = 12, 0.5, 32, 7
THRESHOLD = 0.3
PIECE = 512 << 10

@cache
def _powers() -> np.ndarray:
    out = np.ones(1024, np.uint64)
    for i in range(1, 1024):
        out[i] = np.uint64(int(out[i - 1]) * 0x100000001B3 % 2**64)
    return out


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (((x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature occurrence of the texts: words, pairs of neighbouring words, and n-grams of characters.

    An n-gram lies in one word, whose ends count as a character of their own. A pair of equal words is one feature more,
    whichever word it is.
    """
    held = [t or "" for t in texts]
    size = np.array([len(t) for t in held], np.int64)
    code = np.frombuffer(" ".join(["", *held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), size + 1)
    owner = np.r_[owner[:1] * 0, owner][: len(code)] if len(owner) else np.zeros(len(code), np.int32)
    inside = (code != 32) & ((code < 9) | (code > 13))
    c = np.where(inside, code + np.uint32(1), np.uint32(0)).astype(np.uint64)
    out, rows = [], []
    for n in NGRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        own = inside[1 : m + 1].copy()
        for k in range(2, n - 1):
            own &= inside[k : m + k]
        at = np.flatnonzero(own)
        x = c[at]
        for k in range(1, n):
            x = x * np.uint64(0x100000001B3) + c[at + k]
        out.append(_bucket(x, n))
        rows.append(owner[at + 1])
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = np.flatnonzero(inside)
    if len(at):
        heads = np.searchsorted(at, np.flatnonzero(start))
        word = np.cumsum(start)[at] - 1
        place = np.minimum(np.arange(len(at)) - heads[word], 1023)
        h = np.add.reduceat(c[at] * _powers()[place], heads)
        of = owner[at[heads]]
        pair = np.flatnonzero(of[1:] == of[:-1])
        same = pair[h[pair] == h[pair + 1]]
        out += [_bucket(h, 1), _bucket(h[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + h[pair + 1], 2), _bucket(np.zeros(len(same), np.uint64), 5)]
        rows += [of, of[pair], of[same]]
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    """Per bucket what it adds to the log odds of label 1 before averaging, and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        f, row = features(texts)
        total = np.bincount(row, weights=self.weight[f], minlength=len(texts))
        n = np.bincount(row, minlength=len(texts))
        z = total / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, seed: int = SEED) -> Model:
    """Stochastic gradient descent; classes are weighted so that label 1 has the share it has among all labels."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    own = labels.mean()
    weight = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    sizes = [c.sum() for _, c in bags]
    # the average vector moves by the mean of many small steps; a vector's own step is scaled up to match
    steps = EPOCHS * -(-len(bags) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            some = order[lo : lo + BATCH]
            idx = np.concatenate([bags[i][0] for i in some])
            w = np.concatenate([bags[i][1] / sizes[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            mean = np.stack([np.bincount(doc, weights=w * vectors[idx, k], minlength=len(some)) for k in range(DIMENSIONS)], 1)
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(some)), labels[some]] -= 1
            g *= weight[some][:, None]
            back = g @ layer
            layer -= rate * g.T @ mean
            bias -= 0.1 * rate * g.mean(axis=0)
            for k in range(DIMENSIONS):
                vectors[:, k] -= 20 * rate * np.bincount(idx, weights=w * back[doc, k], minlength=BUCKETS)
    odds = vectors @ (layer[1] - layer[0])
    return Model(odds.astype(np.float32), float(bias[1] - bias[0]))


def learn(rows: DataFrame, sample: int = SAMPLE, text: str = "text", label: str = "label", doc_id: str = "doc_id", counts: DataFrame | None = None) -> Model:
    """Fit on at most ``sample`` rows of each class of ``rows`` (doc_id, text, label 0/1).

    ``counts``: the labelled rows without their texts, where that is cheaper to count and to choose from.
    """
    spark = rows.sparkSession
    known = (rows if counts is None else counts).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    flat = Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))) if n else 0.0)
    if len(n) < 2:
        return flat
    h = F.xxhash64(F.lit(SEED), "i")
    chosen = known.where("y = 0").orderBy(h, "i").limit(sample).unionByName(known.where("y = 1").orderBy(h, "i").limit(sample))
    ids = spark.createDataFrame([(r.i, r.y) for r in chosen.collect()], "i long, y int")  # 2 * sample rows at most

    @lean

    def bag(batches):
        for b in batches:
            held, labels = [], []
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                f, _ = features([t])
                if len(f):
                    u, c = np.unique(f, return_counts=True)
                    held.append(np.stack([u, c]).astype(np.int32).tobytes())
                    labels.append(y)
            yield pa.record_batch([pa.array(held, pa.binary()), pa.array(labels, pa.int32())], names=["f", "y"])

    picked = rows.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(ids), "i").select("t", "y")
    found = [(r.f, r.y) for r in picked.mapInArrow(bag, "f binary, y int").collect()]
    found.sort(key=lambda x: (x[1], bytes(x[0])))
    labels = np.array([y for _, y in found], np.int64)
    if len(set(labels.tolist())) < 2:
        return flat
    bags = [tuple(np.frombuffer(f, np.int32).reshape(2, -1)) for f, _ in found]
    del found
    model = train(bags, labels, share)
    del bags
    release()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", carry: dict[str, Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, score and predicted per row."""
    src = docs.select(F.col(text).alias("_t"), *[c.alias(k) for k, c in (carry or {}).items()])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:])
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean

    def tell(batches):
        m = held.value
        for b in batches:
            for lo, hi in pieces(b, "_t", PIECE):
                s = m.scores(b.column(0).slice(lo, hi - lo).to_pylist())
                yield pa.record_batch([*[c.slice(lo, hi - lo) for c in b.columns[1:]], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names[1:], "score", "predicted"])

    return src.mapInArrow(tell, fields + "score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """Learn from the labels of documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(remainder(F.col("doc_id"), folds) != fold)
    return learn(docs.select("doc_id", "text"), counts=known)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held_out = remainder(docs["doc_id"], folds) == fold
    return predict(docs, fit(docs, labels, folds, fold), carry={"doc_id": docs["doc_id"], "held_out": held_out})


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns."""
    names = docs.columns
    scored = predict(docs, fit(docs, labels), carry={f"_c_{c}": docs[c] for c in names}, threshold=threshold)
    return scored.where("predicted = 1").select(*[F.col(f"_c_{c}").alias(c) for c in names])
