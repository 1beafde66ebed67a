"""Quality rules against plain Python, and the ledger's policies and ablations."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import rules

WORD, LINE = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def plain(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(LINE, x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines), "n_repeat_words": len(covered), "n_capitals": len(re.findall("[A-Z]", t)),
    }
    fails = [
        m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > m["n_words"], 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        m["word_chars"] < 3 * m["n_words"] or m["word_chars"] > 10 * m["n_words"], 100 * m["n_capitals"] > 40 * m["word_chars"], 100 * m["n_bullet_lines"] > 90 * m["n_lines"],
    ]
    return m | {"fail_bits": sum(f << i for i, f in enumerate(fails))}


def texts():
    rng = random.Random(5)
    say = lambda n, k=60: [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(k)) for _ in range(n)]
    block = say(12)
    out = [None, "", " \n\t\x0b ", "one", " ".join(say(19)), " ".join(say(20)), " ".join(["again"] * 9), " ".join(["again"] * 8), " ".join(["ab"] * 5000)]
    out += [" ".join(say(30) + block + say(5) + block + say(9)), " ".join(block + block), " ".join(block[:8] + block[:7]), "\n".join(["same line here", "other"] * 9), "same \nsame\nsame \r\n\n \nsame "]
    out += ["# a | b <c> $5 50% & *" * 4, "- x\n* y\n• z\n   -q", "ALL CAPITALS ÄÖÜ " * 8, "Été ça là \U0001f600 " * 7, "\x00nul \x1f unit", " ".join(say(20000, 9))]
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return out


def test_measurements_and_bits_equal_plain_ones(spark):
    own = texts()
    rows = [(i, t, 1, "x") for i, t in enumerate(own)] + [(None, own[9], 2, None), (3, own[3], 1, "x")]
    # columns named like the operator's own
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string").repartition(3)
    got = rules.ledger(docs).collect()
    want = Counter((d, *[plain(t)[m] for m in (*rules.MEASURES, "fail_bits")], rules.RULES_VERSION) for d, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.bit for r in rules.RULES} == set(range(len(rules.RULES))) and sum(x[-2] >> 1 & 1 for x in want) > 3


def test_equal_hashes_of_windows_are_held_against_the_words(spark, monkeypatch):
    own = texts()[:40]
    monkeypatch.setattr(F, "xxhash64", lambda x: F.size(x).cast("long"))
    docs = spark.createDataFrame(list(enumerate(own[:14] + own[20:])), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in rules.measure(docs).collect()} == {i: plain(t)["n_repeat_words"] for i, t in enumerate(own[:14] + own[20:])}


def test_policies_decide_on_a_stored_ledger(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    path = str(tmp_path / "ledger")
    rules.ledger(docs).write.partitionBy("rules_version").parquet(path)
    stored = spark.read.parquet(path)
    bits = {i: plain(t)["fail_bits"] for i, t in enumerate(texts())}
    for version, own in rules.POLICIES.items():
        got = {r.doc_id: (r.base_failed, r.failed_bits, r.kept) for r in rules.apply_policy(stored, version).collect()}
        assert got == {i: (b & 3 != 0, b & own, b & own == 0) for i, b in bits.items()}
        cut = {r.rule: (r.n_rows, r.n_failed, r.n_alone, r.n_kept, r.n_kept_without) for r in rules.ablations(stored, version).collect()}
        for r in rules.RULES:
            if own >> r.bit & 1:
                x, left = 1 << r.bit, own & ~(1 << r.bit)
                assert cut.pop(r.name) == (len(bits), sum(b & x != 0 for b in bits.values()), sum(b & own == x for b in bits.values()), sum(b & own == 0 for b in bits.values()), sum(b & left == 0 for b in bits.values()))
        assert not cut


def test_another_versions_ledger_and_unknown_rules_are_refused(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    with pytest.raises(Exception, match="other rules"):
        rules.apply_policy(rules.ledger(docs).withColumn("rules_version", F.lit(0))).collect()
    with pytest.raises(ValueError, match="no_such"):
        rules.mask(["symbols", "no_such"])


def test_main_path_is_native_and_moves_no_row(docs):
    plan = rules.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Generate|Join", plan)
    assert plan.count("split(") == 2


def test_no_documents(empty):
    assert rules.judge(empty).collect() == []
    assert {tuple(r)[2:] for r in rules.ablations(rules.ledger(empty)).collect()} == {(0, 0, 0, 0, 0)}
