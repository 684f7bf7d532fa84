"""Exact ranks and running counts of whole columns that no task orders alone.

Rows are cut into ranges of (group, value); equal values may lie in several
ranges, so a value that fills a third of the rows is split like any other.  A
window ranks the rows inside each range; the totals of the ranges before are
added, and values that touch the edge of a range, at most two per range and
group, get their counts over all ranges from a small table.  Where values are
counted to be few, their counts alone are ranked, and rows look them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldmark.constants import CORRELATION_TOP, SEED
from foldmark.functions.kinds import numeric_columns
from foldmark.session import MAX_BROADCAST_ROWS, stored

ROWS_PER_PIECE = 1_000_000
MAX_PIECES = 16_384


def in_ranges(df: DataFrame, order: list[str], rows: int = 0) -> DataFrame:
    """With ``_piece``, which follows the order; ties are spread over pieces.
    So many rows of the table make the pieces more."""
    pieces = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 min(-(-rows // ROWS_PER_PIECE), MAX_PIECES))
    return (df.withColumn("_salt", F.rand(SEED)).repartitionByRange(pieces, *order, "_salt")
            .withColumn("_piece", F.spark_partition_id()).drop("_salt"))


def few_values(df: DataFrame, columns: list[str], about: int) -> DataFrame | None:
    """The distinct values and their rows ``_n``, if they are few enough to
    broadcast; ``about`` is an estimate that saves counting many."""
    if about > 2 * MAX_BROADCAST_ROWS:
        return None
    cells, _ = stored(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "rank-values")
    return cells if cells.count() <= MAX_BROADCAST_ROWS else None


def with_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Add ``less`` and ``ties``: rows of the group with a smaller and with the
    same value, the row itself among them.  Rows without a value are left out."""
    present = df.filter(F.col(value).isNotNull())
    facts = present.agg(F.count(F.lit(1)).alias("n"),
                        F.approx_count_distinct(F.struct(*by, value)).alias("d")).first()
    cells = few_values(present, [*by, value], facts["d"])
    if cells is not None:
        smaller = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(value)
        ranked = cells.select(*by, value, F.coalesce(F.sum("_n").over(
            smaller.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("less"), F.col("_n").alias("ties"))
        return present.join(F.broadcast(ranked), [*by, value])
    piece = W.partitionBy("_piece", *by)
    local, _ = stored(in_ranges(present, [*by, value], facts["n"]).withColumns({
        "_below": F.rank().over(piece.orderBy(value)).cast("bigint") - 1,
        "_same": F.count(F.lit(1)).over(W.partitionBy("_piece", *by, value))}), "ranks")
    edges = local.groupBy("_piece", *by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.min_by("_same", value).alias("n_lo"), F.max_by("_same", value).alias("n_hi"))
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_piece")
    # a row per piece and group
    edges, _ = stored(edges.withColumn("base", F.coalesce(F.sum("n").over(
        earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "rank-edges")
    ends = edges.select(*by, F.explode(F.array(
        F.struct(F.col("lo").alias("v"), F.col("base").alias("start"), F.col("n_lo").alias("k")),
        F.struct(F.col("hi").alias("v"), (F.col("base") + F.col("n") - F.col("n_hi")).alias("start"),
                 F.when(F.col("lo") != F.col("hi"), F.col("n_hi")).otherwise(0).alias("k")))).alias("e"))
    ends = ends.groupBy(*by, F.col("e.v").alias(value)).agg(
        F.min("e.start").alias("_start"), F.sum("e.k").alias("_all"))
    bases = edges.select("_piece", *by, "base")
    return (local.join(F.broadcast(bases), ["_piece", *by]).join(F.broadcast(ends), [*by, value], "left")
            .withColumns({"less": F.coalesce("_start", F.col("base") + F.col("_below")),
                          "ties": F.coalesce("_all", "_same")})
            .drop("_piece", "_below", "_same", "base", "_start", "_all"))


def average_rank() -> Column:
    return F.col("less") + (F.col("ties") + 1) / 2


def percent_ranks(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Add the share of other rows (of the group) with a smaller value, 0 for a
    row alone.  Equal values share the lowest rank; a null has none and counts
    for none."""
    by = by or []
    reserved = {"less", "ties", "_n", "_x"} & set(df.columns)
    if reserved:
        raise ValueError(f"columns with reserved names: {sorted(reserved)}")
    sizes = df.groupBy(*by).agg(F.count(column).alias("_n"))
    counted = with_counts(df.withColumn("_x", F.col(column)), "_x", by)
    if by:
        # one line per group; by shuffle where groups are many
        counted = counted.join(sizes, by)
    else:
        counted = counted.join(F.broadcast(sizes))
    share = F.when(F.col("_n") > 1, F.col("less") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    ranked = counted.withColumn(name, share).select(*df.columns, name)
    return ranked.unionByName(df.filter(F.col(column).isNull()).withColumn(name, F.lit(None).cast("double")))


def spearman(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """``(column, n, corr)``: correlation of average ranks, over the rows where
    both are present; null where either is constant."""
    columns = columns or [c for c in numeric_columns(df) if c != target]

    def number(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    rows = df.select(number(target).alias("y"), *[number(c).alias(f"x{i}") for i, c in enumerate(columns)]) \
        .filter("y IS NOT NULL")
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"x{i}").alias(f"n{i}")
                                                     for i in range(len(columns))]).first()
    # the target's ranks are the same beside all columns without missing values
    whole = [i for i in range(len(columns)) if found[f"n{i}"] == found["n"]]
    sides = [[i] for i in range(len(columns)) if i not in whole and found[f"n{i}"]]
    sides += [whole] if whole and found["n"] else []
    out = df.sparkSession.createDataFrame([], "column string, n long, corr double")
    for side in sides:
        by_y = with_counts(rows.filter(F.col(f"x{side[0]}").isNotNull()).select("y", *[f"x{i}" for i in side]),
                           "y", []).select(average_rank().alias("ry"), *[f"x{i}" for i in side])
        for i in side:
            both = with_counts(by_y.select("ry", f"x{i}"), f"x{i}", []).select("ry", average_rank().alias("rx"))
            a, b = F.col("rx"), F.col("ry")
            out = out.unionAll(both.agg(
                F.lit(columns[i]).alias("column"), F.count(F.lit(1)).alias("n"),
                F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("corr")))
    return out


def spearman_top(df: DataFrame, target: str, top: int = CORRELATION_TOP,
                 columns: list[str] | None = None) -> DataFrame:
    """The columns whose ranks follow the target's most closely."""
    return (spearman(df, target, columns).filter("corr IS NOT NULL")
            .select("column", F.abs("corr").alias("abs_corr"))
            .orderBy(F.desc("abs_corr"), "column").limit(top))
