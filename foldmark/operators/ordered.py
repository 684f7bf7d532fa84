"""Ordered target statistics: categories of any width as numbers, without leaks.

Rows are dealt into pieces by the hash of a key, which puts the pieces into a
random order.  A training row's statistic of its level comes from the rows of
the pieces before its own, so never from its own label; other rows use all
training rows.  Running sums over pieces need one grouped pass: a level has one
row with a slot per piece, and looking it up is the checked, salted join of any
other level table.

A null is a level of its own.  A level not seen before has the mean of what
came before; the first piece, before which there is nothing, has the mean of
the other pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.functions.features import null_token
from foldmark.operators.lookup import LevelTable, lookup
from foldmark.operators.unpivot import long_values
from foldmark.session import materialize

PIECES = 16
PRIOR_WEIGHT = 1.0


def piece_of(key: list[Column], pieces: int = PIECES) -> Column:
    """Place of a row in the random order."""
    return F.pmod(F.xxhash64(F.lit("piece"), *key), F.lit(pieces)).cast("int")


@dataclass(frozen=True)
class OrderedStatistics:
    """Statistics of several parts (training tables), learnt in one pass."""

    columns: list[str]
    levels: DataFrame                       # part, feature, level, counts, sums
    sizes: dict[str, tuple[int, int]]       # levels of each column, and their bytes
    priors: dict[int, list[list[float]]]    # of each part, per slot and output
    outputs: int
    pieces: int
    rows: int
    weight: float

    def names(self, column: str) -> list[str]:
        return [f"__ts_{self.columns.index(column)}_{k}" for k in range(self.outputs)]

    def only(self, part: int) -> OrderedStatistics:
        return replace(self, levels=self.levels.filter(F.col("part") == part),
                       priors={part: self.priors[part]})

    def transform(self, df: DataFrame, spread_by: Column, piece: Column | None = None,
                  part: Column | None = None) -> DataFrame:
        """Add the statistics of every column: of the pieces before ``piece``,
        or of all rows where it is null or not given."""
        last = F.lit(self.pieces)
        slot = ((last if piece is None else F.coalesce(piece, last)) + 1).cast("int")
        part = F.lit(next(iter(self.priors))) if part is None else part
        prior = F.coalesce(*[F.when(part == p, F.element_at(F.array(
            *[F.array(*[F.lit(float(v)) for v in one]) for one in self.priors[p]]), slot))
            for p in self.priors])
        out = df
        for c in self.columns:
            n, size = self.sizes.get(c, (0, 0))
            table = LevelTable(self.levels.filter(F.col("feature") == c), ("part", "level"), n,
                               self.rows, size)
            out = lookup(out, table, [part, null_token(F.col(f"`{c}`"))],
                         {"counts": "_counts", "sums": "_sums"}, spread_by)
            seen = F.coalesce(F.element_at("_counts", slot), F.lit(0.0))
            sums = F.element_at("_sums", slot)
            out = out.withColumns({
                name: (F.coalesce(F.element_at(sums, k + 1), F.lit(0.0))
                       + F.element_at(prior, k + 1) * self.weight) / (seen + self.weight)
                for k, name in enumerate(self.names(c))}).drop("_counts", "_sums")
        return out


def fit_ordered(df: DataFrame, columns: list[str], label: Column, piece: Column, outputs: int = 1,
                pieces: int = PIECES, weight: float = PRIOR_WEIGHT,
                part: Column | None = None) -> OrderedStatistics:
    """Statistics of a numeric label, or of each class for more than one output.

    Rows without a label are left out.
    """
    part = F.lit(0) if part is None else part
    rows = df.filter(label.isNotNull())
    y = label.cast("double") if outputs == 1 else F.lit(1.0)
    kind = F.lit(0) if outputs == 1 else label.cast("int")
    cells = (long_values(rows, {c: null_token(F.col(f"`{c}`")) for c in columns},
                         keep={"_part": part, "_piece": piece, "_kind": kind, "_y": y})
             .groupBy(F.col("_part").alias("part"), F.col("column").alias("feature"),
                      F.col("value").alias("level"), "_piece", "_kind")
             .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s")))
    # an entry per piece and class at most
    entries = cells.groupBy("part", "feature", "level").agg(F.collect_list(
        F.struct(F.col("_piece").alias("p"), F.col("_kind").alias("k"), "n", "s")).alias("e"))

    def total(keep, name: str) -> Column:
        return F.aggregate(F.filter("e", keep), F.lit(0.0), lambda acc, x: acc + x[name])

    slots = F.sequence(F.lit(0), F.lit(pieces))
    classes = F.sequence(F.lit(0), F.lit(outputs - 1))
    levels = materialize(entries.select(
        "part", "feature", "level",
        F.transform(slots, lambda i: total(lambda x: x["p"] < i, "n")).alias("counts"),
        F.transform(slots, lambda i: F.transform(classes, lambda k: total(
            lambda x: (x["p"] < i) & (x["k"] == k), "s"))).alias("sums")))
    sizes = {r["feature"]: (r["n"], r["size"] or 0) for r in levels.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("level") + 8 * (pieces + 1) * (outputs + 1)).alias("size")).collect()}
    # as many lines as there are parts, pieces and classes
    facts = rows.groupBy(part.alias("part"), piece.alias("p"), kind.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")).collect()

    def means(keep) -> list[float]:
        n = sum(r["n"] for r in facts if keep(r))
        return [sum(r["s"] for r in facts if keep(r) and r["k"] == k) / n if n else 0.0
                for k in range(outputs)]

    priors = {q: [means(lambda r, q=q: r["part"] == q and r["p"] > 0),
                  *[means(lambda r, q=q, i=i: r["part"] == q and r["p"] < i) for i in range(1, pieces + 1)]]
              for q in sorted({r["part"] for r in facts})}
    return OrderedStatistics(columns, levels, sizes, priors or {0: [[0.0] * outputs] * (pieces + 1)},
                             outputs, pieces, sum(r["n"] for r in facts), weight)
