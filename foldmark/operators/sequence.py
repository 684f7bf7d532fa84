"""Running features along an ordered sequence per entity.

A plain window puts a whole entity into one task.  When the largest entity is
counted to be too big for that, the rows are cut into ranges of entity, order
and key, the window runs inside each piece, and the totals of the pieces before
are added.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldmark.operators.encode import as_level_table
from foldmark.operators.lookup import lookup
from foldmark.session import stored

ROWS_PER_PIECE = 2_000_000
MAX_PIECES = 16_384


def largest_group(df: DataFrame, by: list[str]) -> int:
    row = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return row[0] or 0


def pieces(df: DataFrame, entity: list[str], order: str, key: str,
           rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame | None:
    """Rows with ``_piece``, written; none when plain windows will do.

    ``_piece`` follows entity, order and key, in the order of their own types,
    so an order value that fills many rows is cut by the key.
    """
    if largest_group(df, entity) <= rows_per_piece:
        return None
    wanted = min(max(2, -(-df.count() // rows_per_piece)), MAX_PIECES)
    cut = (df.repartitionByRange(wanted, *entity, order, key)
           .withColumn("_piece", F.spark_partition_id()))
    return stored(cut, "sequence-pieces")[0]


def at_piece(entity: list[str]) -> list[Column]:
    """Key of an entity's part of a piece; nulls are values like any other."""
    return [F.to_json(F.struct(*entity)), F.col("_piece")]


def event_history(df: DataFrame, entity: list[str], order: str, key: str, flag: Column,
                  count_name: str = "cum_count", since_name: str = "since_last",
                  rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Add the running number of flagged rows and the rows since the last one.

    The count includes the row itself; "since" is 0 on a flagged row, and
    counts from the first row of the entity until there is one.  Both restart
    with every entity; to restart at a split too, name its column in
    ``entity``.  Ties in the order are settled by ``key``.
    """
    rows = df.withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    cut = pieces(rows, entity, order, key, rows_per_piece)
    split = [] if cut is None else ["_piece"]
    group = W.partitionBy(*entity, *split).orderBy(order, key)
    so_far = group.rowsBetween(W.unboundedPreceding, 0)
    local = ((rows if cut is None else cut)
             .withColumns({"_rn": F.row_number().over(group).cast("bigint"),
                           "_cum": F.sum("_flag").over(so_far)})
             .withColumn("_last", F.max(F.when(F.col("_flag") == 1, F.col("_rn"))).over(so_far)))
    made = ["_flag", "_rn", "_cum", "_last"]
    if cut is None:
        since = F.col("_rn") - F.coalesce("_last", F.lit(1))
        return local.withColumns({count_name: F.col("_cum"), since_name: since}).drop(*made)

    before = (W.partitionBy(*entity).orderBy("_piece")
              .rowsBetween(W.unboundedPreceding, -1))
    totals = (local.groupBy(*entity, "_piece")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("_flag").alias("flags"),
                   F.max("_last").alias("last"))
              .withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
                            "flags_before": F.coalesce(F.sum("flags").over(before), F.lit(0))})
              .withColumn("last_before",
                          F.max(F.col("n_before") + F.col("last")).over(before)))
    totals = totals.withColumn("_entity", at_piece(entity)[0])
    offsets = as_level_table(totals, ("_entity", "_piece"), df.count())
    placed = lookup(local, offsets, at_piece(entity),
                    {"n_before": "_nb", "flags_before": "_fb", "last_before": "_lb"},
                    F.col(key))
    place = F.col("_nb") + F.col("_rn")
    last = F.coalesce(F.col("_nb") + F.col("_last"), F.col("_lb"), F.lit(1))
    return (placed.withColumns({count_name: F.col("_fb") + F.col("_cum"),
                                since_name: place - last})
            .drop(*made, "_piece", "_nb", "_fb", "_lb"))


def running_max_before(df: DataFrame, entity: list[str], order: str, key: str,
                       value: Column, name: str,
                       rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Add the largest value among the earlier rows of the entity."""
    rows = df.withColumn("_x", value)
    cut = pieces(rows, entity, order, key, rows_per_piece)
    split = [] if cut is None else ["_piece"]
    earlier = (W.partitionBy(*entity, *split).orderBy(order, key)
               .rowsBetween(W.unboundedPreceding, -1))
    local = (rows if cut is None else cut).withColumn("_m", F.max("_x").over(earlier))
    if cut is None:
        return local.withColumn(name, F.col("_m")).drop("_x", "_m")
    before = (W.partitionBy(*entity).orderBy("_piece")
              .rowsBetween(W.unboundedPreceding, -1))
    totals = (cut.groupBy(*entity, "_piece")
              .agg(F.count(F.lit(1)).alias("n"), F.max("_x").alias("m"))
              .withColumn("m_before", F.max("m").over(before)))
    totals = totals.withColumn("_entity", at_piece(entity)[0])
    offsets = as_level_table(totals, ("_entity", "_piece"), df.count())
    placed = lookup(local, offsets, at_piece(entity), {"m_before": "_mb"}, F.col(key))
    return (placed.withColumn(name, F.greatest("_m", "_mb"))
            .drop("_x", "_m", "_mb", "_piece"))
