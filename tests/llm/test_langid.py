import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid

SOUNDS = {"aa": "bdgmnr", "bb": "ptksfz", "cc": "бджзлр"}


def say(lang, n, rng):
    vowels = "аеио" if lang == "cc" else "aeio"
    return " ".join("".join(rng.choice(SOUNDS[lang]) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, say(k, rng.randint(3, 60), rng), k, "s", 0) for i in range(300) for k in [sorted(SOUNDS)[i % 3]]]
    rows += [(900, None, "aa", None, 0), (901, "", "bb", None, 0), (902, "123 -- !", "aa", None, 0), (903, "漢字", None, None, 0), (None, say("bb", 9, rng), None, None, 0), (904, say("aa", 30, rng) + " " + say("bb", 30, rng) + " " + say("cc", 10, rng), None, None, 0), (905, "x" * 300_000, None, None, 0)]
    path = str(tmp_path_factory.mktemp("lang") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_held_out_accuracy(table):
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    want = {r.doc_id: r.lang for r in table.collect()}
    held = [d for d in range(300) if got[d].held_out]
    assert 60 < len(held) < 140 and np.mean([got[d].lang_pred == want[d] for d in held]) > 0.97
    assert [(got[d].lang_pred, got[d].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred in SOUNDS and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans_of_mixed_text(table):
    model = langid.learn(table.where("lang is not null"))
    r = langid.predict(table.where("doc_id = 904"), model, spans=True).first()
    assert [s.lang for s in r.spans] == ["aa", "bb", "cc"]
    text = table.where("doc_id = 904").first().text
    assert text[r.spans[1].start : r.spans[1].stop].split()[0][0] in SOUNDS["bb"]


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 1, 9, 2, 30])
    scores = rng.normal(size=(lengths.sum(), 3)) * 4
    prior = np.log([0.5, 0.3, 0.2])
    got, at = langid.viterbi(scores, lengths, prior, 3.0), 0
    for n in lengths:
        own, s = got[at : at + n], scores[at : at + n]
        at += n
        if n:
            v = s[0] + prior
            for t in range(1, n):
                v = s[t] + np.maximum(v, v.max() - 3.0)
            value = prior[own[0]] + s[np.arange(n), own].sum() - 3.0 * (own[1:] != own[:-1]).sum()
            assert np.isclose(value, v.max())


def test_nothing_to_learn(spark, table, empty):
    assert {r.lang_pred for r in langid.predict(table, langid.learn(table.where("lang = 'zz'"))).collect()} == {"und"}
    assert langid.identify(empty).count() == 0


def plain(rows):
    """Languages and scores by dictionaries of strings, word by word."""
    script = lambda w: "Cyrillic" if "\u0400" <= w[0] <= "\u052f" else "Latin" if w[0] <= "\u024f" else "Han"
    words = lambda t: "".join(x if x.isalpha() else " " for x in (t or "")).lower().split()
    grams = lambda w: [f" {w} "[i : i + 3] for i in range(len(w))]
    count, scripts, texts = defaultdict(Counter), defaultdict(set), Counter()
    for d, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 3 != 1:
            texts[lang] += 1
            for w in words(t):
                count[lang, "gram"].update(grams(w))
                count[lang, "word"][w] += 1
                scripts[lang].add(script(w))
    langs = sorted(texts)
    size = {k: sum(c.values()) + langid.SMOOTH * langid.HALF for k, c in count.items()}
    p = lambda k, kind, x: math.log((count[k, kind][x] + langid.SMOOTH) / size[k, kind])
    prior = [math.log((texts[k] + 1) / (sum(texts.values()) + len(langs))) for k in langs]
    out = []
    for d, t, _ in rows:
        w = words(t)
        if not w:
            out.append((d, "und", 0.0))
            continue
        best, back = None, []
        for x in w:
            able = [k for k in langs if script(x) in scripts[k]] or None
            s = [0.0 if able is None else sum(p(k, "gram", g) for g in grams(x)) + p(k, "word", x) if k in able else -1e6 for k in langs]
            if best is None:
                best = [a + b for a, b in zip(prior, s)]
                continue
            top = max(range(len(langs)), key=lambda i: best[i])
            back.append([i if best[i] >= best[top] - langid.PENALTY else top for i in range(len(langs))])
            best = [best[j] - (langid.PENALTY if j != i else 0) + s[i] for i, j in enumerate(back[-1])]
        at = max(range(len(langs)), key=lambda i: best[i])
        share = Counter({langs[at]: len(w[-1])})
        for i in range(len(w) - 2, -1, -1):
            at = back[i][at]
            share[langs[at]] += len(w[i])
        name = min(share, key=lambda k: (-share[k], k))
        out.append((d, name, share[name] / sum(share.values())))
    return out


def test_equals_plain_python(spark, table, monkeypatch):
    odd = table.withColumnsRenamed({"source": "held_out", "n_chars": "bucket"}).withColumn("_t", table["lang"]).withColumn("score", table["doc_id"])
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(odd).collect()), key=str)
    want = sorted(((d, k, round(s, 9)) for d, k, s in plain(rows)), key=str)
    assert len(got) == len(want) and sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    monkeypatch.setattr(langid, "PIECE", 200)
    monkeypatch.setattr(langid, "MOST_SCORES", 300)
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(table).collect()), key=str) == got


def test_too_many_languages_are_refused(table, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(table)
