"""Sources mixed to target weights by a temperature.

A source with share p of all tokens gets a weight in proportion to p ** a.
With a = 1 the mixture is the corpus; towards 0 the sources become equal, so
the entropy rises and small sources are repeated more.  Both are monotone in
a, so the exponent that meets a target entropy, or a limit on repetition, is
bisected: each round tries a grid of exponents over the table of sources.

The weights are then realised within a token budget.  A source that is owed
more than it holds is read in several passes, each in a permutation of its
own; the last pass stops when the source's part of the budget is reached.  The
stream is cut into blocks of a token budget in which every source has its
weight, and each block is permuted again.

Only column functions are used.  A source may hold a third of all rows: running
totals are taken in pieces of the permutation, never over a whole source.

Defined results: a text counts its words and one end mark, so null and empty
texts count 1; a null source is a source of its own; rows that share an id, or
have none, are separate rows with written numbers of their own, which settle
ties of the permutation; names of other columns never clash; without rows, or
with a budget of 0, there is no result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.llm.order import in_pieces, running, small, written

SPACES = r"[\x20\x09-\x0D]+"
GRID = 32
ROUNDS = 9


@dataclass(frozen=True)
class Mixture:
    """What a mixture must meet; the exponent lies between 0 and 1.

    ``budget`` is in tokens per token of the corpus.  ``entropy`` is a share of
    the largest possible one (all sources equal).  With both targets the
    exponent is the larger one that they ask for, so no source is repeated
    beyond the limit, which must be at least the budget.
    """
    budget: float = 1.0
    max_repeats: float | None = 4.0
    entropy: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 17

    def __post_init__(self) -> None:
        if self.max_repeats is not None and self.max_repeats < self.budget:
            raise ValueError("a budget above the limit on repetition cannot be met")


def tokens_of(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
    return (F.size(words) + 1).cast("long")


def tried(sources: DataFrame, total: int, n: int, low: float, high: float,
          budget: float) -> list[tuple]:
    """(exponent, entropy share, most repeats) over a grid of exponents."""
    exponents = [low + (high - low) * i / GRID for i in range(GRID + 1)]
    rows = sources.select("_held", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    raised = F.pow(F.col("_held") / F.lit(total), F.col("a"))
    found = rows.groupBy("a").agg(
        F.sum(raised).alias("z"), F.sum(raised * F.col("a") * F.log(F.col("_held") / F.lit(total)))
        .alias("s"), F.max(raised / F.col("_held")).alias("r"))
    share = (F.log("z") - F.col("s") / F.col("z")) / F.lit(math.log(n) if n > 1 else 1.0)
    return [tuple(r) for r in found.select(
        "a", share if n > 1 else F.lit(1.0),
        F.lit(budget * total) * F.col("r") / F.col("z")).orderBy("a").collect()]


def exponent(sources: DataFrame, total: int, n: int, mix: Mixture) -> float:
    """The flattest exponent within the repetition limit, not flatter than
    the entropy target asks for."""
    def bisected(enough) -> float:  # enough(row): true from some exponent on
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = tried(sources, total, n, low, high, mix.budget)
            at = next((i for i, r in enumerate(rows) if enough(r)), len(rows) - 1)
            if at == 0:
                return rows[0][0]
            low, high = rows[at - 1][0], rows[at][0]
        return high

    found = [0.0]
    if n == 0:
        return 1.0
    if mix.entropy is not None:
        found.append(bisected(lambda r: r[1] <= mix.entropy))
    if mix.max_repeats is not None:
        found.append(bisected(lambda r: r[2] <= mix.max_repeats * (1 + 1e-12)))
    return max(found)


def weights(sizes: DataFrame, mix: Mixture) -> DataFrame:
    """Per source: tokens held, weight, and tokens owed under the budget.

    ``sizes`` has ``_source`` and ``_tokens`` per document.
    """
    sources = written(sizes.groupBy("_source").agg(F.sum("_tokens").alias("_held")), "mix-sources")
    total, n = sources.agg(F.coalesce(F.sum("_held"), F.lit(1)), F.count(F.lit(1))).first()
    raised = F.pow(F.col("_held") / F.lit(total), F.lit(exponent(sources, total, n, mix)))
    norm = sources.agg(F.sum(raised)).first()[0] or 1.0
    weight = raised / F.lit(norm)
    owed = weight * F.lit(total * mix.budget)
    if mix.max_repeats is not None:  # rounding must not begin another pass
        owed = F.least(owed, F.col("_held") * F.lit(float(mix.max_repeats)))
    return sources.select("_source", "_held", weight.alias("_weight"), owed.alias("_owed"))


def placed(rows: DataFrame, mix: Mixture) -> DataFrame:
    """Of numbered rows (_row, _key, _source, _tokens): _row, tokens, weight,
    pass, block and slot of every copy that is read."""
    owed = written(weights(rows, mix), "mix-weights")
    passes = F.ceil(F.col("_owed") / F.col("_held")).cast("int")
    own = owed.withColumnRenamed("_source", "_s")
    copies = (rows.join(small(own), F.col("_source").eqNullSafe(F.col("_s"))).filter(passes > 0)
              .withColumn("_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
              .select("_row", "_key", "_source", "_tokens", "_pass", "_held", "_weight", "_owed",
                      F.xxhash64(F.lit(mix.seed), "_pass", "_key", "_tokens").alias("_turn")))
    # rows that are alike in all that is hashed go by their number
    order = ["_turn", "_key", "_tokens", "_row"]
    found = running(in_pieces(copies, order, "mix-copies"), order,
                    {"_before": F.col("_tokens")}, ["_source", "_pass"])
    at = F.col("_pass") * F.col("_held") + F.col("_before")
    taken = (found.filter(at < F.col("_owed"))
             .withColumn("_block", F.floor(at / (F.col("_weight") * F.lit(mix.block_tokens)))))
    shuffled = F.xxhash64(F.lit(mix.seed), "_block", "_pass", "_key", "_tokens")
    taken = in_pieces(taken.withColumn("_shuffled", shuffled).select(
        "_row", "_key", "_source", "_tokens", "_weight", "_pass", "_block", "_shuffled"),
        ["_block", "_shuffled", "_row"], "mix-taken")
    return running(taken, ["_shuffled", "_row"], {"_slot": F.lit(1)}, ["_block"])


def mixed(docs: DataFrame, mix: Mixture = Mixture(), key: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """Key, source, tokens, weight, pass, block and slot: one row per copy.

    Blocks are in reading order, slots number the documents of a block.
    """
    rows = written(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"),
                               tokens_of(F.col(f"`{text}`")).alias("_tokens"),
                               F.monotonically_increasing_id().alias("_row")), "mix-sizes")
    return placed(rows, mix).select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_tokens").alias("tokens"),
        F.col("_weight").alias("weight"), F.col("_pass").alias("pass"),
        F.col("_block").cast("long").alias("block"), F.col("_slot").cast("long").alias("slot"))


def mixed_documents(docs: DataFrame, mix: Mixture = Mixture(), key: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as the mixture reads it, whatever their names."""
    whole = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                                F.monotonically_increasing_id().alias("_row")), "mix-documents")
    rows = written(whole.select(
        "_row", F.col("_doc")[key].alias("_key"), F.col("_doc")[source].alias("_source"),
        tokens_of(F.col("_doc")[text]).alias("_tokens")), "mix-sizes")
    copies = written(placed(rows, mix).groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_copies")),
                     "mix-counts")
    return (whole.join(small(copies), "_row")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
            .select("_doc.*"))
