"""Running totals along an order that no single task holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from foldmark.session import MAX_BROADCAST_ROWS, discard, stored

_TIDIED: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read from there on."""
    found, path = stored(df, name)
    if _TIDIED:
        _TIDIED[-1].append(path)
    return found


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are removed at the end; what is
    read later has to be :func:`~foldmark.session.stored`."""
    _TIDIED.append([])
    try:
        yield
    finally:
        for path in _TIDIED.pop():
            discard(spark, path)


def width(spark: SparkSession) -> int:
    """Pieces to cut a table into; the setting follows the size of the data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows it is small; narrow rows only."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def in_pieces(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Written with ``_piece``, which follows the order (nulls first).

    Ties of the whole order stay in one piece.
    """
    cut = (df.repartitionByRange(width(df.sparkSession), *order)
           .withColumn("_piece", F.spark_partition_id()))
    return written(cut, name)


def running(pieces: DataFrame, order: list[str], values: dict[str, Column],
            within: list[str] | None = None) -> DataFrame:
    """Add exclusive running sums along ``order``, restarting per ``within``.

    Sums run inside each piece; the totals of the pieces before, one row per
    piece and group, are added.
    """
    groups = within or []
    local = W.partitionBy("_piece", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = {f"_own_{k}": F.coalesce(F.sum(v).over(local), F.lit(0)) for k, v in values.items()}
    totals = pieces.groupBy("_piece", *groups).agg(
        *[F.sum(v).alias(f"_all_{k}") for k, v in values.items()])
    # one row per piece and group: as many as there are tasks, times the groups
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0)))
    before = before.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = written(totals.select(
        F.col("_piece").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in groups],
        *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_off_{k}")
          for k in values]), "offsets")
    match = F.col("_piece") == F.col("_p")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (pieces.withColumns(own).join(small(offsets), match, "left")
            .withColumns({k: F.col(f"_own_{k}") + F.col(f"_off_{k}") for k in values})
            .drop("_p", *own, *[f"_g_{g}" for g in groups], *[f"_off_{k}" for k in values]))
