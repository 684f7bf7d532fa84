"""Level lookups that neither broadcast blindly nor pile up on a hot level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.session import MAX_BROADCAST_ROWS, materialize

# A level with more than this share of the rows is hot. At most 1 / HOT_SHARE
# levels can be, so the list of hot levels has a proven size.
HOT_SHARE = 0.001
SALTS = 64
# Levels can be long texts, so a broadcast is bounded in bytes too.
MAX_BROADCAST_BYTES = 32_000_000


@dataclass(frozen=True)
class LevelTable:
    """A written table with one row per level.

    ``keys`` identify a level, ``n`` counts the rows it was learned from,
    ``rows`` is the counted size of the table, ``size`` the bytes of its keys.
    """

    table: DataFrame
    keys: tuple[str, ...]
    rows: int
    total: int
    size: int = 0

    @property
    def broadcastable(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS and self.size <= MAX_BROADCAST_BYTES


def lookup(df: DataFrame, levels: LevelTable, on: list[Column],
           values: dict[str, str], spread_by: Column) -> DataFrame:
    """Left join of level values onto rows.

    ``on`` are the row expressions matched with ``levels.keys``; ``values``
    maps value columns of the table to output names.  A table counted to be
    small is broadcast.  A larger one is joined by shuffle.  Levels that are
    hot in the rows at hand are counted there; their rows are spread by
    ``spread_by`` (an id) and they are repeated in the table.  Rows without a
    level match nothing and are spread as well.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    rows = df.withColumns(dict(zip(keys, on)))
    side = levels.table.select(
        *[F.col(k).alias(a) for k, a in zip(levels.keys, keys)],
        *[F.col(v).alias(out) for v, out in values.items()])
    if levels.broadcastable:
        return rows.join(F.broadcast(side), keys, "left").drop(*keys)
    salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    hot = materialize(counts.filter(F.col("_n") > total * HOT_SHARE).dropna(subset=keys)
                      .select(*keys, F.lit(True).alias("_hot")))
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    salt = F.when(F.col("_hot") | empty, F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(0)
    rows = (rows.join(F.broadcast(hot), keys, "left")
            .withColumn("_salt", salt.cast("int")).drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))) \
        .otherwise(F.array(F.lit(0)))
    side = (side.join(F.broadcast(hot), keys, "left")
            .withColumn("_salt", F.explode(copies)).drop("_hot"))
    return rows.join(side, [*keys, "_salt"], "left").drop(*keys, "_salt")
