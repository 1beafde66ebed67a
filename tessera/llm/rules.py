"""Quality rules as a ledger of bits: measure once, decide later.

Every rule is evaluated once on a document's measurements; what it fails is a bit of ``fail_bits``. The ledger of
bits and measurements is what is stored. A policy is a versioned set of rules, so a mask; it is applied to a stored
ledger by one bitwise AND, and its ablations (what each rule removes, what it alone removes, what stays without it)
come from counts by bit pattern, without reading a text again.

All measurements are expressions on one row's text: no row is split up or moved, so neither a source that holds a third
of the rows nor a very long text makes a hot key. Windows of words are compared by hash first and, where a
text has equal hashes, by the words themselves.

Null texts count as empty and have no words; a null ``doc_id`` stays null; repeated rows and ties are judged one by
one; other columns of the documents are left out; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import saved

#: Words are runs of other characters than these.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window that is looked for again.
WINDOW = 8
#: Changes when a rule's bit or threshold does; ledgers of another version can't be read by these policies.
RULES_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` of its measurements is true. ``base`` rules are part of every policy."""

    bit: int
    name: str
    fails: Callable[[], Column]
    base: bool = False


def _c(name: str) -> Column:
    return F.col(name)


#: Whole numbers on both sides, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", lambda: _c("n_words") < 20, base=True),
    Rule(1, "repeated_words", lambda: 100 * _c("n_repeat_words") > 30 * _c("n_words"), base=True),
    Rule(2, "symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
    Rule(4, "word_length", lambda: (_c("word_chars") < 3 * _c("n_words")) | (_c("word_chars") > 10 * _c("n_words"))),
    Rule(5, "capitals", lambda: 100 * _c("n_capitals") > 40 * _c("word_chars")),
    Rule(6, "bullets", lambda: 100 * _c("n_bullet_lines") > 90 * _c("n_lines")),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_repeat_words", "n_capitals")


def mask(names: Iterable[str] | None = None) -> int:
    """Bits of the named rules, of all without names; ValueError for an unknown one."""
    known = {r.name: 1 << r.bit for r in RULES}
    names = list(known) if names is None else list(names)
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown rules: {unknown}")
    return sum({known[n] for n in names})


BASE = mask(r.name for r in RULES if r.base)
#: Policies by version; each holds the base rules. The last is what the query applies.
POLICIES = {
    1: BASE,
    2: BASE | mask(["symbols", "repeated_lines"]),
    3: mask(),
}
CURRENT = max(POLICIES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it stands in it or in its lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def _shared(items: Column, key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """Places of the sorted ``items`` whose neighbour has the same key."""
    def beside(s: Column) -> Column:
        same = lambda x, i: (key(x) == key(F.get(s, i - 1))) | (key(x) == key(F.get(s, i + 1)))
        return F.filter(F.transform(s, lambda x, i: F.when(same(x, i), place(x))), lambda p: p.isNotNull())

    return _let(F.sort_array(items), beside)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words of the array lie in windows of ``window`` words that stand twice or more, the first included."""
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def places(h: Column) -> Column:
        near = _shared(F.transform(h, lambda x, i: F.struct(x.alias("k"), (i + 1).alias("p"))), lambda x: x["k"], lambda x: x["p"])
        # equal hashes are held against the words themselves
        return F.sort_array(_shared(F.transform(near, lambda p: F.struct(F.array_join(F.slice(words, p, window), " ").alias("k"), p.alias("p"))), lambda x: x["k"], lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
        return F.aggregate(p, start, lambda a, x: F.struct((a["n"] + x + window - F.greatest(x, a["stop"])).alias("n"), (x + window).alias("stop")), lambda a: a["n"])

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(0)
    return F.when(F.size(words) > window, _let(hashes, some)).otherwise(0)


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the measurements (long) of every row."""
    t = F.coalesce(docs[text], F.lit(""))
    words, lines = F.array_remove(F.split(t, SPACES), ""), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # bound as a lambda's value the arrays are held as references; slices of a column's array would copy it whole
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines")))
    d = docs.select(docs[doc_id].alias("doc_id"), by_word.alias("w"), by_line.alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).alias("n_symbols"), F.length(F.regexp_replace(t, "[^A-Z]+", "")).alias("n_capitals"))
    return d.select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals").select("doc_id", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, measurements, fail_bits (bit i set where rule i fails) and rules_version of every row."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text, doc_id).select("*", bits.alias("fail_bits"), F.lit(RULES_VERSION).alias("rules_version"))


def apply_policy(stored: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Adds base_failed, failed_bits (those of the policy) and kept to a ledger; no text is read."""
    own = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    same = F.when(F.col("rules_version") == RULES_VERSION, own).otherwise(F.raise_error(F.lit("the ledger was made by other rules")))
    return stored.select("*", base.alias("base_failed"), same.alias("failed_bits")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_bits") == 0))


def ablations(stored: DataFrame, policy: int = CURRENT) -> DataFrame:
    """A row for each rule of the policy: n_rows, n_failed, n_alone (failed by no other rule), n_kept and n_kept_without it.

    Rows are counted by bit pattern where they are (2 to the number of rules patterns at most); rules meet those counts.
    An empty ledger gives zeros.
    """
    own = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    patterns = stored.groupBy(own.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if POLICIES[policy] >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in rules]))
    zero = stored.sparkSession.range(1).select(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    rows = patterns.unionByName(zero).select("b", "n", each.alias("r")).select("b", "n", "r.*")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    hit = F.col("b").bitwiseAND(F.col("own")) != 0
    alone = F.col("b") == F.col("own")
    return rows.groupBy("bit", "rule").agg(
        F.sum("n").alias("n_rows"), total(hit).alias("n_failed"), total(alone).alias("n_alone"), total(F.col("b") == 0).alias("n_kept"), total((F.col("b") == 0) | alone).alias("n_kept_without"),
    )


def judge(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """The ledger, stored below the shared folder, with a policy applied to it."""
    return apply_policy(saved(ledger(docs), "rules"), policy)
