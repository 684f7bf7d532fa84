"""Isotonic calibration of out-of-fold predictions.

The best non-decreasing function of the prediction, by pooling neighbours that
violate the order.  Pooling may be done in pieces: rows are summed up by
prediction, ranges of them are pooled in separate tasks, and the blocks that
remain are pooled again in fewer ranges, until one is left.  What is pooled last
are blocks, not rows.

A row is calibrated by the function of the other folds, never of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from foldmark.session import MAX_BROADCAST_ROWS, stored

MERGE = 16      # ranges that become one in a round
BLOCK = "slot int, low double, high double, n double, s double"


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[list[float]]:
    """Blocks (low, high, n, s) of increasing mean, from blocks in order."""
    out: list[list[float]] = []
    for a, z, k, total in zip(low, high, n, s):
        block = [a, z, k, total]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            before = out.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        out.append(block)
    return out


def fit_isotonic(df: DataFrame, pred: str, label: str, fold: str, folds: int) -> DataFrame:
    """(slot, low, high, value): slot k leaves fold k out, the last has all rows."""
    def pool(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("low")
        found = pooled(*[g[c].to_numpy() for c in ("low", "high", "n", "s")])
        out = pd.DataFrame(found, columns=["low", "high", "n", "s"])
        out.insert(0, "slot", g["slot"].iloc[0])
        return out

    present = df.filter(F.col(pred).isNotNull() & F.col(label).isNotNull())
    cells = present.groupBy(F.col(pred).cast("double").alias("low"), F.col(fold).cast("int").alias("_f")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    slots = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("_f"))
    points = (cells.withColumn("slot", F.explode(slots)).groupBy("slot", "low")
              .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
              .select(F.col("slot").cast("int").alias("slot"), "low", F.col("low").alias("high"), "n", "s"))
    pieces = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks, _ = stored(points.repartitionByRange(pieces, "slot", "low")
                       .withColumn("piece", F.spark_partition_id()), "isotonic")
    while True:
        # one round's ranges are the next one's rows, so a group shrinks as it is merged
        done, _ = stored(blocks.groupBy("slot", "piece").applyInPandas(
            lambda key, g: pool(g).assign(piece=key[1]), BLOCK + ", piece int"), "isotonic")
        if pieces <= 1:
            return done.select("slot", "low", "high", (F.col("s") / F.col("n")).alias("value"))
        pieces = -(-pieces // MERGE)
        blocks = done.withColumn("piece", F.floor(F.col("piece") / MERGE).cast("int"))


def calibrated(df: DataFrame, pred: str, label: str, fold: str, folds: int,
               name: str = "calibrated") -> DataFrame:
    """Add calibrated predictions, each by the function of the other folds.

    Between two blocks the function is a straight line, outside it is constant;
    a fold whose other folds hold no labelled row has none.
    """
    blocks = fit_isotonic(df, pred, label, fold, folds)
    n = blocks.count()
    if n > MAX_BROADCAST_ROWS:
        raise ValueError(f"the calibration has {n} steps; round the predictions first")
    curves = {}
    for r in blocks.orderBy("slot", "low").collect():
        x, y = curves.setdefault(r["slot"], ([], []))
        for at in dict.fromkeys((r["low"], r["high"])):
            x.append(at)
            y.append(r["value"])

    @pandas_udf("double")
    def apply(p: pd.Series, k: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=p.index, dtype=float)
        for slot in k.dropna().unique():
            at = (k == slot) & p.notna()
            if int(slot) in curves and at.any():
                out[at] = np.interp(p[at].to_numpy(float), *curves[int(slot)])
        return out.astype(object).where(out.notna(), None)

    return df.withColumn(name, apply(F.col(pred).cast("double"), F.col(fold).cast("int")))
