"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is measured once for each text, in one pass without a shuffle. The ledger keeps the measurements and one
failure bit for each rule. Policies are named masks over these bits, so a new policy, or a policy without one of its
rules, is a bitwise test on the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without_white

#: Words in a window whose repetition counts.
SPAN = 8


@dataclass(frozen=True)
class Rule:
    """A test that a document fails where `fails` is true; its bit is its place in RULES."""

    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", lambda: F.col("n_words") < 20),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
BIT = {rule.name: 1 << place for place, rule in enumerate(RULES)}

#: Versioned policies: the rules of which a document may fail none.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(BIT),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; hashes: one for each window, in order."""

    def twice(pairs: Column) -> Column:
        hit = F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(hit, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, zero,
            lambda a, p: F.struct((p + SPAN).alias("end"), (a["n"] + p + SPAN - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, twice))


def _words(text: Column) -> Column:
    def measured(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - (SPAN - 1)), lambda i: F.xxhash64(F.slice(words, i, SPAN)))
        repeats = F.when(F.size(words) <= SPAN, F.lit(0)).otherwise(_let(windows, _covered))
        return F.struct(F.size(words).alias("n"), repeats.alias("repeats"))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), measured)


def _lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))


def quality_ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, the measurements (long), failed_bits (long).

    Measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words. A null or empty text measures
    0 throughout (and fails few_words); repeated rows are measured alike; an empty table gives no rows; other columns
    play no part. Windows are compared by 64-bit hashes within one text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), _words(body).alias("w"), _lines(body).alias("l"),
        F.length(without_white(body)).alias("word_chars"), F.regexp_count(body, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    ).select(
        "doc_id", *(F.col(c).cast("long").alias(n) for c, n in (
            ("w.n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("l.n", "n_lines"), ("l.again", "n_dup_lines"), ("w.repeats", "n_repeat_words"))),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Add base_failed and kept under a versioned policy."""
    fails = lambda m: F.col("failed_bits").bitwiseAND(F.lit(m)) != 0
    return ledger.withColumn("base_failed", fails(mask("base"))).withColumn("kept", ~fails(mask(policy) | mask("base")))


def ablations(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that fail it alone, and rows kept without it.

    The ledger is first summed to one row for each pattern of bits, 2 ** rules at most.
    """
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy]))).alias("x")
    each = patterns.select("bits", "n", rules).select("bits", "n", "x.rule", "x.bit")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("failed"),
        count(bits == bit).alias("failed_alone"),
        count(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
        F.bit_or("bits").alias("bits_seen"),
    )
