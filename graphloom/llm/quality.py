"""Quality rules as a bitmask ledger.

``measure`` reads every text once and stores its measurements; ``ledger`` turns
them into one failure bit per rule. Policies are versioned masks over those bits,
so a verdict, a changed policy or an ablation never reads texts again: verdicts
are ``bits & mask``, ablations are bitwise aggregates over the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of

_SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named bit; ``fails`` is a SQL condition over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "odd_word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule(5, "shouting", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    Rule(6, "no_letters", "4 * n_letters < word_chars"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_upper", "n_repeat_words")

#: Version -> names of the rules it applies.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def measure(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The input row as struct _row, doc_id and MEASURES (long), from one read of each whole text.

    A null or empty text has zeros everywhere; texts of fewer than three words
    have no repeated windows. Windows of three words are compared within a text by
    a 64-bit hash: sorted with their places, equal windows are neighbours, and each
    such window covers three words less its overlap with the next one.
    """
    t = F.col("_t")
    long = lambda c: c.cast("bigint")
    df = df.select(F.struct("*").alias("_row"), F.col(id_column).alias("doc_id"), text_of(text).alias("_t"))
    df = df.withColumns({"_w": F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": long(F.size("_w")), "word_chars": long(F.char_length(F.translate(t, _SPACES, ""))), "n_symbols": long(F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))),
        "n_lines": long(F.size("_l")), "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_letters": long(F.char_length(F.regexp_replace(t, r"\P{L}+", ""))), "n_upper": long(F.char_length(F.regexp_replace(t, r"\P{Lu}+", ""))),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_t", "_w", "_l")
    window = F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    df = df.withColumn("_x", window).drop("_h")
    # Most texts repeat no window: nothing is sorted for them.
    repeats = F.size(F.array_distinct("_x")) < F.size("_x")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_x")
    twin = F.transform("_s", lambda x, k: F.when((F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("_i", F.sort_array(F.filter(twin, lambda i: i.isNotNull()))).drop("_s")
    covered = F.aggregate(F.transform("_i", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_i", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", long(F.coalesce(covered, F.lit(0)))).select("_row", "doc_id", *MEASURES)


def ledger(measures: DataFrame) -> DataFrame:
    """Adds fail_bits (long): bit k is set if rule k fails. Every rule is evaluated once."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    # A filter on the bits must not be pushed below the measurements: it would repeat them inside its condition, nested.
    return measures.withColumn("fail_bits", bits + F.monotonically_increasing_id() * 0)


def verdict(policy: str) -> Column:
    """kept under a policy, from fail_bits alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: n_failed, n_only (what would be kept without the rule); one row per rule, none read a text.

    Rows are first counted by bit pattern, of which there are at most 2 ** len(RULES).
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0, F.col("n")).otherwise(0)), F.lit(0)).alias(f"a{r.bit}") for r in RULES if mask >> r.bit & 1]
    sums += [F.coalesce(F.sum(F.when(F.col("bits") == 1 << r.bit, F.col("n")).otherwise(0)), F.lit(0)).alias(f"o{r.bit}") for r in RULES if mask >> r.bit & 1]
    one = patterns.agg(*sums)
    rules = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"a{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in RULES if mask >> r.bit & 1])
    return one.select(F.inline(rules))


def score(df: DataFrame, id_column: str = "doc_id", text: str = "text", policy: str = "v1") -> DataFrame:
    """One row per input row: the contract's columns, then the other measurements and the ledger's bits."""
    rows = ledger(measure(df, id_column, text))
    base = ~verdict("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict(policy).alias("kept"), "n_lines", "n_letters", "n_upper", "fail_bits")


def filter_rows(df: DataFrame, id_column: str = "doc_id", text: str = "text", policy: str = "v1") -> DataFrame:
    """The input rows, all their columns, that a policy keeps."""
    return ledger(measure(df, id_column, text)).filter(verdict(policy)).select("_row.*")
