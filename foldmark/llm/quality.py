"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds what was
measured and one integer whose bit ``i`` says that rule ``i`` failed.  A policy
is a named version of a mask: judging, comparing policies and asking what each
rule removes alone are bitwise operations on the ledger and never read a text.

Only column functions are used; nothing is shuffled to build a ledger.

Defined results: a null or empty text has zero for every measure and fails
``few_words``; a document stands for itself, so repeated rows give repeated
rows; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` is true over the measures."""
    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "shouting", "2 * n_capitals > word_chars"),
    Rule(5, "exclamations", "2 * n_exclaims > n_words"),
    Rule(6, "word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
)
BASE = ("few_words", "repeated_words")
# Versions are only ever added: a stored ledger can be judged again by any of them.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "2024-1": BASE + ("symbols", "repeated_lines"),
    "2024-2": BASE + ("symbols", "repeated_lines", "shouting", "exclamations"),
    "strict": tuple(r.name for r in RULES),
}
CURRENT = "2024-2"


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def windows_of(words: Column) -> Column:
    """A 64-bit hash of every three-word window, in order."""
    n = F.size(words)
    shifted = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"),
                           F.slice(words, 3, n).alias("c"))
    hashed = F.transform(shifted, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    return F.slice(hashed, 1, F.greatest(n - 2, F.lit(0)))


def repeated_at(placed: Column) -> Column:
    """Sorted positions of hashes that occur again, from sorted (hash, position)."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    near = F.arrays_zip(placed.alias("own"), F.slice(placed, 2, F.size(placed)).alias("after"),
                        F.concat(none, placed).alias("before"))
    found = F.filter(near, lambda x: x["own"].isNotNull() & (
        x["own"]["h"].eqNullSafe(x["after"]["h"]) | x["own"]["h"].eqNullSafe(x["before"]["h"])))
    return F.sort_array(F.transform(found, lambda x: x["own"]["i"]))


def covered_words(at: Column) -> Column:
    """Words covered by three-word windows at these positions."""
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and all measures, one row per row of ``docs``."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    words, lines, windows = F.col("_words"), F.col("_lines"), F.col("_windows")
    marks = F.col("_marks")
    # Each projection names what later ones use several times, so that nothing
    # is split twice.
    parts = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
             .select("_key", F.array_remove(F.split(t, SPACES), "").alias("_words"),
                     F.regexp_replace(t, r"[^#*$%&|<>!\p{Lu}]+", "").alias("_marks"),
                     F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
                     .alias("_lines"))
             .withColumn("_windows", windows_of(words)))
    # Windows are compared by hash inside one document.  Most documents repeat
    # none and sort nothing; the others take n log n for n words.
    parts = parts.withColumn("_placed", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    parts = parts.withColumn("_repeats", repeated_at(F.col("_placed")))

    def count(dropped: str) -> Column:
        return F.length(F.regexp_replace(marks, dropped, "")).cast("long")

    return parts.select(
        F.col("_key").alias(key),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered_words(F.col("_repeats")), F.lit(0)).cast("long")
        .alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count(r"[#*$%&|<>!]+").alias("n_capitals"),
        count(r"[^!]+").alias("n_exclaims"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Key, measures and ``failed``: the bits of the rules that failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, key, text).withColumn("failed", failed.cast("long"))


def judged(ledger_rows: DataFrame, policy: str = CURRENT,
           policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under one version of the policy."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names))) != 0
    return (ledger_rows.withColumn("base_failed", hit(BASE))
            .withColumn("kept", ~hit(tuple(policies[policy]) + BASE)))


def ablation(ledger_rows: DataFrame, policy: str = CURRENT,
             policies: Mapping[str, tuple[str, ...]] = POLICIES,
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, and those only it fails.

    The ledger is first counted by its distinct bitmasks (at most
    2 ** number of rules), so the rules are compared on that small table.
    """
    mask = mask_of(policies[policy], rules)
    counts = (ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits"))
              .agg(F.count(F.lit(1)).alias("n")))
    named = [r for r in rules if r.name in policies[policy]]
    each = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for r in named]))
    return (counts.select("bits", "n", each.alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))
                       .otherwise(0)).alias("fails"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))
                       .otherwise(0)).alias("fails_alone")))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text",
              policy: str = CURRENT) -> DataFrame:
    """Rows of ``docs`` that pass; each row is judged by its own text."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = judged(ledger(packed.select("_row", F.col(f"_row.`{text}`").alias("_text")),
                         "_row", "_text"), policy)
    # the row number keeps the filter here: moved below, it would repeat the
    # measuring expressions many times over
    rows = rows.withColumn("_at_row", F.monotonically_increasing_id())
    return rows.filter("kept AND _at_row >= 0").select("_row.*")
