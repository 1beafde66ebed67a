import random
import re

from tessera.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = sorted((i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    "one",
    "...",
    "Licensed under the Apache License, Version 2.0.",
    "MIT License. mit-license! MIT  LICENSE and CC BY 4.0; cc by",
    "gnu gnu general public license general public license; GNU General Public License",
    "été MIT LİCENSE mit\tlicense 12",
    "gnu general public apache license",
    "cc " * 50 + "by " + "cc by " * 3,
    "x " * 3000 + licenses.NOTICES[0][1] + " y" * 100,
    licenses.NOTICES[3][1].replace("modification", "some further modification of it"),
    " ".join(licenses.NOTICES[3][1].split()[:12]),
]


def test_equals_brute_force(spark):
    rows = [(i % 7 if i else None, t) for i, t in enumerate(TEXTS)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(d, *brute(t)) for d, t in rows], key=str)


def test_notices_are_found_with_words_put_in(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].labels == "mit" and got[10].score == 1.0 and got[10].base_labels == ""
    assert got[10].spans[0].start == 3000
    assert got[11].labels == "bsd" and 0.6 <= got[11].score < 1
    assert got[12].labels == "" and got[12].score == 0
    assert got[5].labels == "cc-by,mit" and got[5].n_base == 5
    for r in got.values():
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_other_columns_and_empty_tables(spark, docs, empty):
    assert licenses.scan(docs.withColumnsRenamed({"lang": "row", "source": "w", "n_chars": "votes"})).count() == docs.count()
    assert licenses.scan(empty).count() == 0


def test_no_python_in_the_plan(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


MIT = licenses.NOTICES[0][1]


def test_repeated_and_disordered_words_are_no_notice(spark):
    half = len(MIT) // 2
    rows = [(0, "of the " * 35), (1, "the license " * 25), (2, "the software " * 60 + MIT + " the software" * 60), (3, MIT[half:] + " " + MIT[:half]), (4, " ".join(reversed(words(MIT)))), (5, (MIT + " ") * 3)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].labels, got[i].score) for i in (0, 1, 3, 4)] == [("", 0.0)] * 4
    assert got[2].labels == "mit" and got[2].score == 1.0 and [x.start for x in got[2].spans] == [120]
    assert got[5].labels == "mit" and [x.start for x in got[5].spans] == [len(words(MIT)) * i for i in range(3)]


def longest(votes):
    """Longest chain forward in both texts, by all pairs of votes."""
    best = {}
    for p, t in sorted(votes):
        best[p, t] = 1 + max((n for (q, u), n in best.items() if q < p and u < t), default=0)
    return max(best.values(), default=0)


def method(text, notices):
    """Labels and best share of the notices: every bundle of two cells of diagonals, by plain Python."""
    w, out = words(text), {}
    for label, notice in notices:
        v = words(notice)
        pairs, cell = len(v) - 1, max(1, licenses.DRIFT * len(v) // 100)
        votes = [(i, j) for i in range(len(w) - 1) for j in range(pairs) if w[i : i + 2] == v[j : j + 2]]
        for own in {(i - j) // cell - k for i, j in votes for k in (0, 1)}:
            n = longest([(i, j) for i, j in votes if own <= (i - j) // cell <= own + 1])
            if 100 * n >= licenses.COVER * pairs:
                out[label] = max(out.get(label, 0), n / pairs)
    return ",".join(sorted(out)), max(out.values(), default=0.0)


def test_labels_equal_brute_force_on_repeating_text(spark):
    rng = random.Random(8)
    notices = [("one", "a b a c a b d"), ("two", "b a b a c c d a b d a"), ("three", "a a a b a a a b a a a c d b c a")]
    rows = [(i, " ".join(rng.choice("aaabbcd") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    for i in range(120, 160):
        cut = rng.choice(notices)[1].split()
        for _ in range(rng.randint(0, 4)):
            j = rng.randrange(len(cut))
            cut[j : j + rng.randint(0, 1)] = [rng.choice("abcde") for _ in range(rng.randint(0, 2))]
        rows.append((i, " ".join([rng.choice("abcd") for _ in range(rng.randint(0, 20))] + cut + [rng.choice("abcd") for _ in range(rng.randint(0, 20))])))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=[], notices=notices).collect()}
    assert got == {i: method(t, notices) for i, t in rows}
    assert len({x for x, _ in got.values()}) > 3
