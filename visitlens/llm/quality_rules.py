"""Quality rules as a ledger of failure bits.

Every rule is measured once per document. The ledger keeps the measurements and
one bit per failed rule, so that a policy, which says which bits reject, can be
changed, versioned and compared later without reading a text again. What each
rule of a policy adds is computed from counts per bit pattern.

Only column functions are used. Shapes of a text (words, windows, lines) stay
inside its row; nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import staged, whole

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """Rejects rows with a failed rule of ``hard``, or more than ``most_soft`` of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    most_soft: int = 0


#: A bit is never used anew for another rule; add rules at the end.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("upper_case", 5, "n_upper > 50 and 2 * n_upper > word_chars"),
    Rule("exclamation", 6, "10 * n_exclaimed > 3 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length",
                        "upper_case", "exclamation"))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_exclaimed")


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _covered(starts: Column) -> Column:
    """Words covered by windows at the given sorted starts."""
    step = lambda acc, at: F.struct(
        (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("total"), at.alias("last"))
    first = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, first, step, lambda acc: acc["total"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``MEASURES`` of each row, and the whole row as ``row``.

    A null text has no words. Windows are compared by a 64-bit hash of their
    three words.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("row", "doc_id", "words", F.size("words").alias("n"), lines.alias("lines"),
                 F.char_length(F.array_join("words", "")).alias("word_chars"),
                 F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
                 F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
                 F.regexp_count("text", F.lit(r"!!")).alias("n_exclaimed"))
    windows = F.when(F.col("n") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.expr("array()"))
    d = d.withColumn("windows", windows)
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(repeats, F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("sorted", i - 1)["h"].eqNullSafe(x["h"])
                         | F.get("sorted", i + 1)["h"].eqNullSafe(x["h"]))
    d = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.array_sort(
        F.transform(F.filter("sorted", same), lambda x: x["i"]))))
    return d.select(
        "row", "doc_id", _long(F.col("n")).alias("n_words"), _long(F.col("word_chars")).alias("word_chars"),
        _long(F.col("n_symbols")).alias("n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _long(F.when(F.col("starts").isNull(), 0).otherwise(_covered(F.col("starts")))).alias("n_repeat_words"),
        _long(F.size("lines")).alias("n_lines"), _long(F.col("n_upper")).alias("n_upper"),
        _long(F.col("n_exclaimed")).alias("n_exclaimed"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits`` of each row.

    A text without words fails ``few_words`` only where the rule says so; null,
    empty and repeated rows are rows like others, an empty table gives no rows, and
    only ``doc_id`` and ``text`` are read.
    """
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs).withColumn("failed_bits", bits)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: 1 << r.bit for r in rules}
    return sum(by_name[n] for n in names)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failed_bits") -> Column:
    hard = F.col(bits).bitwiseAND(F.lit(mask(policy.hard, rules)).cast("bigint")) == 0
    soft = F.bit_count(F.col(bits).bitwiseAND(F.lit(mask(policy.soft, rules)).cast("bigint")))
    return hard & (soft <= policy.most_soft) if policy.soft else hard


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: ``rule, failed, sole`` and ``kept_without``, the rows a policy without it keeps.

    Rows are first counted per bit pattern (at most two to the number of rules).
    """
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for r in (r for r in rules if r.name in policy.hard + policy.soft):
        less = Policy(policy.version, tuple(n for n in policy.hard if n != r.name),
                      tuple(n for n in policy.soft if n != r.name), policy.most_soft)
        one = patterns.agg(
            F.lit(r.name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("failed_bits").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0, F.col("n"))),
                       F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(~passes(policy, rules) & passes(less, rules), F.col("n"))), F.lit(0)).alias("sole"),
            F.coalesce(F.sum(F.when(passes(less, rules), F.col("n"))), F.lit(0)).alias("kept_without"))
        out = one if out is None else out.unionByName(one)
    return out


def stored_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger without the rows it was measured on, written once; policies and ablations read it."""
    return staged(ledger(docs, rules).drop("row"), "quality-ledger")


def apply_policy(entries: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger entries with ``base_failed``, the verdict ``kept`` and the ``policy_version`` it comes from.

    The base rules always reject.
    """
    return entries.select(
        *entries.columns, (~passes(BASE, rules)).alias("base_failed"),
        (passes(BASE, rules) & passes(policy, rules)).alias("kept"), F.lit(policy.version).alias("policy_version"))


def judge(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``apply_policy`` over the stored ledger of ``docs``."""
    return apply_policy(stored_ledger(docs), policy)


def keep_good(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``docs`` without the rows that the policy rejects; columns unchanged, nothing is joined.

    Each row's entry is unfolded from an array of one, so that the verdict is not
    pushed below the measurements, where each rule would repeat them.
    """
    entries = apply_policy(ledger(docs), policy).select("row", F.explode(F.array(F.struct("kept"))).alias("entry"))
    return entries.filter("entry.kept").select("row.*")
