"""Language identification: spans of mixed-language text by Viterbi over word scores.

A word is a run of letters and marks of one script. Scripts are told by code point ranges, and only
languages that were seen with a word's script can label it. A word's score under a language is the
sum of log probabilities of its character trigrams and of the word itself, from hashed counts over
all learning rows. Viterbi with a penalty for each switch of language then labels all words of a
text; runs of one label are its spans.

Counting and labelling are map-only passes over whole texts; between them the counts are summed by
(language, bucket), at most ``BUCKETS`` rows a language, which bounds what is broadcast.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does every text
where nothing could be learned. Rows with null language or null text teach nothing; repeated rows teach
once each; other columns are ignored. More than ``MOST_LANGUAGES`` languages are refused. Texts are
handled in pieces of bounded size, a text longer than that by itself. Otherwise the
score is the share of the text's letters that the predicted language labels. Ties go to the
language that sorts first.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lean, pieces, remainder

#: Trigrams are hashed to the first half of the buckets and words to the second.
BUCKETS = 1 << 17
HALF = BUCKETS // 2
#: Cost of a switch in nats, weight of the word beside its trigrams, added to each count.
PENALTY, WORD_WEIGHT, SMOOTH = 8.0, 1.0, 0.2
#: More languages than this are refused: the model is sent to every executor.
MOST_LANGUAGES = 256
#: Bytes of text whose words are scored at once in a worker, and bytes times languages of texts whose labels are found side by side.
PIECE, MOST_SCORES = 512 << 10, 32 << 20

# First and last code points of scripts' main blocks.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0250, 0x02AF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0x20000, 0x2FA1F, "Han"),
]
NAMES = ["other", *sorted({s for _, _, s in SCRIPTS})]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script (0 other, 255 not part of a word) and its lower case."""
    kind, lower = np.full(0x110000, 255, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(x := chr(c))[0] in "LM":
            kind[c] = 0
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    for lo, hi, s in SCRIPTS:
        part = kind[lo : hi + 1]
        part[part != 255] = NAMES.index(s)
    return kind, lower


@cache
def _marks() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])


class Words:
    """The words of some texts as arrays: text, first code point, script, letters and hashed grams."""

    def __init__(self, texts: list[str | None]):
        kind, lower = _tables()
        held = [t or "" for t in texts]
        self.lengths = np.array([len(t) for t in held], np.int64)
        code = np.frombuffer(" ".join(["", *held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        script = kind[code].copy()
        mark = _marks()[code]
        # a mark belongs to the script of the letter before it
        for i in np.flatnonzero(mark & (script != 255)):
            script[i] = script[i - 1]
        inside = script != 255
        start = inside & (script != np.r_[255, script[:-1]])
        at = np.flatnonzero(start)
        where = np.flatnonzero(inside)
        self.n = len(at)
        self.script = script[at]
        word = np.cumsum(start)[where] - 1
        self.first = np.searchsorted(where, at)
        self.letters = np.bincount(word, weights=~mark[where], minlength=self.n).astype(np.int64)
        begin = 1 + np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.doc = np.searchsorted(begin, at, side="right") - 1
        self.at = at - begin[self.doc]
        self.stop = self.at + np.bincount(word, minlength=self.n)
        c = np.where(inside, lower[code], 32).astype(np.uint64)
        edge = start[where]
        left = np.where(edge, np.uint64(32), c[where - 1])
        right = np.where(np.r_[edge[1:], True], np.uint64(32), c[where + 1])
        x = (left * np.uint64(0x9E3779B97F4A7C15) + c[where]) * np.uint64(0xC2B2AE3D27D4EB4F) + right
        self.gram = ((x * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64) % HALF
        self.word = word
        if self.n:
            # a polynomial over the letters, by their place in the word
            place = (np.arange(len(where)) - self.first[word]).astype(np.uint64)
            y = np.add.reduceat((c[where] + np.uint64(1)) * _powers()[np.minimum(place, np.uint64(255)).astype(np.int64)], self.first)
            self.whole = HALF + ((y * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % HALF
        else:
            self.whole = np.empty(0, np.int64)


@cache
def _powers() -> np.ndarray:
    out = np.ones(256, np.uint64)
    for i in range(1, 256):
        out[i] = np.uint64(int(out[i - 1]) * 0x100000001B3 % 2**64)
    return out


class Model:
    """Log probabilities by bucket and language, and which languages use which script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, texts: np.ndarray):
        self.languages = languages
        table = np.empty((BUCKETS, len(languages)), np.float32)
        for half in (slice(0, HALF), slice(HALF, BUCKETS)):
            for i in range(len(languages)):
                c = counts[i, half].astype(np.float64) + SMOOTH
                table[half, i] = np.log(c / c.sum())
        table[HALF:] *= WORD_WEIGHT
        self.table = table
        self.uses = scripts > 0
        texts = texts.astype(np.float64) + 1
        self.prior = np.log(texts / texts.sum())

    def scores(self, w: Words) -> np.ndarray:
        """Per word and language; a script that no language uses tells nothing."""
        if not w.n:
            return np.empty((0, len(self.languages)), np.float32)
        s = np.add.reduceat(self.table[w.gram], w.first, axis=0) + self.table[w.whole]
        ok = self.uses[:, w.script].T
        s = np.where(ok, s, np.float32(-1e6))
        s[~ok.any(axis=1)] = 0
        return s - s.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word; texts follow each other in ``scores`` and go on side by side, word by word."""
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    stay, best = np.ones((n, k), bool), np.zeros(n, np.int16)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    v = None
    for t in range(steps):
        m = active[t]
        i = start[:m] + t
        if t == 0:
            v = scores[i] + prior
            continue
        v = v[:m]
        top = v.argmax(axis=1)
        cut = v[np.arange(m), top] - penalty
        keep = v >= cut[:, None]
        stay[i], best[i] = keep, top
        v = np.where(keep, v, cut[:, None]) + scores[i]
        # the last word of a text fixes where the way back starts
        done = size[:m] == t + 1
        if done.any():
            labels[i[done]] = v[done].argmax(axis=1)
    one = size == 1
    labels[start[one]] = (scores[start[one]] + prior).argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        i = start[: active[t]] + t
        l = labels[i]
        labels[i - 1] = np.where(stay[i, l], l, best[i])
    return labels


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Counts over all of ``rows``, summed by language and bucket."""
    @lean
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in pieces(b, "t", PIECE):
                langs = b.column("l").slice(lo, hi - lo).to_pylist()
                w = Words(b.column("t").slice(lo, hi - lo).to_pylist())
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                for j, name in enumerate(names):
                    c = held.setdefault(name, np.zeros(BUCKETS + len(NAMES) + 1, np.int64))
                    own = which[w.doc] == j
                    c[:BUCKETS] += np.bincount(w.gram[own[w.word]], minlength=BUCKETS) + np.bincount(w.whole[own], minlength=BUCKETS)
                    c[BUCKETS:-1] += np.bincount(w.script[own], minlength=len(NAMES))
                    c[-1] += langs.count(name)
        for name, c in held.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    def dense(group: pa.Table) -> pa.Table:
        c = np.zeros(BUCKETS + len(NAMES) + 1, np.float32)
        c[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table([group.column("lang").slice(0, 1).combine_chunks(), pa.array([c.tobytes()], pa.binary())], names=["lang", "counts"])

    given = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    sums = given.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = {}
    for r in sums.groupBy("lang").applyInArrow(dense, "lang string, counts binary").toLocalIterator():  # a row of half a megabyte for each language
        found[r.lang] = np.frombuffer(r.counts, np.float32)
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages; the model holds no more")
    if not found:
        return None
    languages = sorted(found, key=lambda x: x.encode())
    counts = np.stack([found[x] for x in languages])
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS:-1], counts[:, -1])


def label(model: Model, texts: list[str | None]):
    """Words by piece, their number in each text, and their labels."""
    parts, scores, held, size = [], [], [], 0

    def add():
        w = Words(held)
        scores.append(model.scores(w))
        w.gram = w.word = w.whole = w.first = None  # only the words themselves are needed from here on
        parts.append(w)

    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= PIECE:
            add()
            held, size = [], 0
    add()
    scores = np.concatenate(scores)
    lengths = np.concatenate([np.bincount(w.doc, minlength=len(w.lengths)) for w in parts])
    return parts, lengths, viterbi(scores, lengths, model.prior)


def predict(docs: DataFrame, model: Model | None, text: str = "text", carry: dict[str, Column] | None = None, spans: bool = False) -> DataFrame:
    """The carried columns, lang_pred and score per row; with ``spans`` also array<struct<start,stop,lang>>, in code points."""
    carry = carry or {}
    src = docs.select(F.col(text).alias("_t"), *[c.alias(k) for k, c in carry.items()])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[1:])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean

    def tell(batches):
        m = held.value
        limit = MOST_SCORES // (1 if m is None else len(m.languages))
        for whole in batches:
            for lo, hi in pieces(whole, "_t", limit):
                b = whole.slice(lo, hi - lo)
                names, scores, found = ["und"] * b.num_rows, [0.0] * b.num_rows, [[] for _ in range(b.num_rows)]
                if m is not None:
                    k = len(m.languages)
                    parts, lengths, labels = label(m, b.column(0).to_pylist())
                    letters = np.concatenate([w.letters for w in parts])
                    doc = np.repeat(np.arange(len(lengths)), lengths)
                    share = np.bincount(doc * k + labels, weights=letters, minlength=b.num_rows * k).reshape(-1, k)
                    total = share.sum(axis=1)
                    top = share.argmax(axis=1)
                    for i in np.flatnonzero(total):
                        names[i], scores[i] = m.languages[top[i]], float(share[i, top[i]] / total[i])
                    if spans:
                        at, stop = np.concatenate([w.at for w in parts]), np.concatenate([w.stop for w in parts])
                        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])]) if len(doc) else []
                        for x, y in zip(new, np.r_[new[1:], len(doc)] if len(doc) else []):
                            found[doc[x]].append({"start": int(at[x]), "stop": int(stop[y - 1]), "lang": m.languages[labels[x]]})
                yield pa.record_batch([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64()), *([pa.array(found, kind)] if spans else [])], names=[*b.schema.names[1:], "lang_pred", "score", *(["spans"] if spans else [])])

    return src.mapInArrow(tell, fields + "lang_pred string, score double" + ", spans array<struct<start:long,stop:long,lang:string>>" * spans)


def identify(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows of the held-out fold teach nothing."""
    held_out = remainder(docs["doc_id"], folds) == fold
    model = learn(docs.where(~held_out))
    return predict(docs, model, carry={"doc_id": docs["doc_id"], "held_out": held_out})
