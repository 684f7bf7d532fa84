"""Mutual information of a continuous column with classes, by nearest neighbours.

For a row of a class with n rows, k is the lesser of ``neighbours`` and n - 1
and r the distance to the k-th nearest row of the class; m counts the rows of
any class nearer than r, the row itself among them.  Where r is 0, m counts the
equal rows and k those of them in the class, so that columns with repeated
values are measured by their levels.  Over the rows of classes with two rows or
more, N of them,

    I = psi(N) + mean psi(k) - mean psi(n) - mean psi(m)

and at least 0.  Values are not jittered.

Neighbours are sought inside ranges of (column, class, value); the last and
first k rows of the ranges around travel along, so borders change nothing.
Rows nearer than r are counted by running totals: the two ends of each row's
interval are put into the order of the values.  No task holds a whole column
or class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from foldmark.operators.ranks import in_ranges, with_counts
from foldmark.session import stored

NEIGHBOURS = 3
EULER = 0.5772156649015329
EXACT = 20      # psi of smaller numbers is summed up


def psi(n: Column) -> Column:
    """Digamma of a positive integer."""
    small = [-EULER + math.fsum(1 / i for i in range(1, k)) for k in range(1, EXACT)]
    x = n.cast("double")
    series = (F.ln(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6))
    return F.when(n < EXACT, F.element_at(F.array(*[F.lit(v) for v in small]),
                                          F.least(n, F.lit(EXACT - 1)).cast("int"))).otherwise(series)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))


def interval(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value above x, and the greatest below, at r or more from it.

    Bisected over all doubles by the differences as computed, so that rounding
    cannot move a row from one side to the other; next to x itself where r is 0.
    """
    out = []
    for sign in (1.0, -1.0):
        u = sign * x                            # the lower end is the upper one mirrored
        low = _flipped(u.view(np.int64).copy())
        high = _flipped((u + 2 * r).view(np.int64).copy())
        for _ in range(64):
            middle = (low >> 1) + (high >> 1) + (low & high & 1)
            far = _flipped(middle).view(np.float64) - u >= r
            high = np.where(far, middle, high)
            low = np.where(far, low, middle)
        t = _flipped(high).view(np.float64)
        out.append(sign * np.where(r == 0, np.nextafter(u, np.inf), t))
    return out[0], out[1]


def radii(rows: DataFrame, k: int) -> DataFrame:
    """(column, y, x, k, n, r) over (column, y, x, ties): the equal rows of the class."""
    sizes = rows.groupBy("column", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes, _ = stored(sizes, "class-sizes")
    place = W.partitionBy("_piece", "column", "y")
    cut, _ = stored(in_ranges(rows, ["column", "y", "x"]).withColumns({
        "_first": F.row_number().over(place.orderBy("x")),
        "_last": F.row_number().over(place.orderBy(F.desc("x")))}), "neighbour-pieces")
    # at most 2 k rows per piece, column and class
    edge = cut.filter((F.col("_first") <= k) | (F.col("_last") <= k))
    ends = edge.groupBy("column", "y", "_piece").agg(
        F.sort_array(F.collect_list(F.when(F.col("_first") <= k, F.col("x")))).alias("low"),
        F.sort_array(F.collect_list(F.when(F.col("_last") <= k, F.col("x"))), asc=False).alias("high"))
    order = W.partitionBy("column", "y").orderBy("_piece")
    # a piece holding fewer than k rows hands on those of the pieces beyond it
    around = ends.withColumns({
        "before": F.slice(F.sort_array(F.flatten(F.collect_list("high").over(
            order.rowsBetween(-k, -1))), asc=False), 1, k),
        "after": F.slice(F.sort_array(F.flatten(F.collect_list("low").over(
            order.rowsBetween(1, k)))), 1, k)})
    ghosts = around.select("column", "y", "_piece", F.explode(F.concat("before", "after")).alias("x"),
                           F.lit(True).alias("ghost"))
    ghosts = ghosts.withColumn("ties", F.lit(0).cast("bigint"))
    whole = cut.select("column", "y", "_piece", "x", F.lit(False).alias("ghost"), "ties").unionByName(ghosts)
    near = W.partitionBy("_piece", "column", "y").orderBy("x")
    x = F.col("x")
    gaps = F.array(*[g for i in range(1, k + 1)
                     for g in (x - F.lag("x", i).over(near), F.lead("x", i).over(near) - x)])
    wanted = F.least(F.lit(k), F.col("n") - 1).cast("int")
    return (whole.withColumn("_gaps", F.sort_array(F.array_compact(gaps))).filter(~F.col("ghost"))
            .join(sizes, ["column", "y"]).withColumn("k", wanted)
            .withColumn("r", F.element_at("_gaps", F.col("k")))
            .withColumn("k", F.when(F.col("r") == 0, F.col("ties")).otherwise(F.col("k")))
            .select("column", "y", "x", "k", "n", "r"))


def counted_within(rows: DataFrame) -> DataFrame:
    """Rows with ``m``, over (column, row, x, r)."""
    @pandas_udf("above double, below double")
    def ends(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        above, below = interval(x.to_numpy(float), r.to_numpy(float))
        return pd.DataFrame({"above": above, "below": below})

    marks = rows.withColumn("e", ends("x", "r")).select("column", "row", F.explode(F.array(
        # at one value: lower ends after the rows there, upper ends before them
        F.struct(F.col("e.above").alias("at"), F.lit(0).alias("kind")),
        F.struct(F.col("x").alias("at"), F.lit(1).alias("kind")),
        F.struct(F.col("e.below").alias("at"), F.lit(2).alias("kind")))).alias("m")).select(
        "column", "row", "m.at", "m.kind")
    cut = in_ranges(marks, ["column", "at", "kind"])
    one = (F.col("kind") == 1).cast("bigint")
    placed = cut.withColumn("_key", F.struct("at", "kind"))
    running = W.partitionBy("_piece", "column").orderBy("_key").rangeBetween(
        W.unboundedPreceding, W.currentRow)
    local, _ = stored(placed.withColumn("_own", F.sum(one).over(running)).drop("_key"), "neighbour-marks")
    totals = local.groupBy("_piece", "column").agg(F.sum(one).alias("n"))
    before = W.partitionBy("column").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    # a row per piece and column
    totals = totals.select("_piece", "column", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ends_only = local.filter("kind <> 1").join(F.broadcast(totals), ["_piece", "column"])
    count = F.col("_base") + F.col("_own")
    return ends_only.groupBy("column", "row").agg(
        F.sum(F.when(F.col("kind") == 0, count).otherwise(-count)).alias("m"))


def neighbour_information(df: DataFrame, features: list[str], y: str,
                          neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(column, n, mutual_info)`` of numeric columns with a discrete y.

    Null is a class of its own; rows without a value of the column are left
    out of it.
    """
    level = F.coalesce(F.concat(F.lit("="), F.col(f"`{y}`").cast("string")), F.lit(""))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x"))
                      for c in features])
    rows = (df.select(level.alias("y"), F.explode(cells).alias("c")).select("c.column", "y", "c.x")
            .filter("x IS NOT NULL AND NOT isnan(x)"))
    rows = with_counts(rows, "x", ["column", "y"]).drop("less")
    found, _ = stored(radii(rows, neighbours).withColumn("row", F.monotonically_increasing_id()),
                      "neighbour-radii")
    within = counted_within(found.select("column", "row", "x", "r"))
    parts = found.join(within, ["column", "row"]).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(psi(F.col("k")) - psi(F.col("n")) - psi(F.col("m"))).alias("rest"))
    return parts.select("column", "n", F.greatest(psi(F.col("n")) + F.col("rest"), F.lit(0.0))
                        .alias("mutual_info"))
