"""One row per (row, column): the base of every per-column statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def long_values(df: DataFrame, columns: dict[str, Column] | list[str],
                keep: dict[str, Column] | None = None) -> DataFrame:
    """Columns as ``(column, value string)`` rows, beside the kept columns."""
    if not isinstance(columns, dict):
        columns = {c: F.col(c) for c in columns}
    keep = keep or {}
    wide = df.select(*[expr.alias(name) for name, expr in keep.items()],
                     *[expr.cast("string").alias(name) for name, expr in columns.items()])
    return wide.unpivot([F.col(name) for name in keep],
                        [F.col(f"`{name}`") for name in columns], "column", "value")


def long_stats(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """All aggregates of all columns in one pass, as one row per column.

    ``per_column`` maps a column to ``{stat: aggregate}``; every column has
    the same stats, in the same order.
    """
    names = list(per_column)
    stats = list(next(iter(per_column.values())))
    row = df.agg(*[per_column[c][s].alias(f"_{i}_{s}")
                   for i, c in enumerate(names) for s in stats])
    parts = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"_{i}_{s}").alias(s) for s in stats])
        for i, c in enumerate(names)])
    return row.select(F.explode(parts).alias("s")).select("s.*")
