"""Predictions as a submission table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.functions.labels import decode_probabilities
from foldmark.session import materialize
from foldmark.operators.framing import ProblemSpec


def running_number(df: DataFrame, name: str = "id") -> DataFrame:
    """Numbers 0, 1, 2, … without moving the rows.

    Rows are counted per partition; the short list of partition sizes gives
    each partition its first number.  The rows are written first, so that
    both uses see the same partitions.
    """
    fixed = materialize(df.withColumn("_pid", F.spark_partition_id())
                        .withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["_pid"]: r["n"] for r in fixed.groupBy("_pid")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for pid in sorted(sizes):
        starts.append((pid, total))
        total += sizes[pid]
    # one row per partition: as short as the list just collected
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_pid int, _first bigint"))
    # the lower 33 bits of the monotonic id count rows inside a partition
    place = F.col("_at") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (fixed.join(first, "_pid", "left")
            .withColumn(name, (F.col("_first") + place).cast("bigint"))
            .drop("_pid", "_at", "_first"))


def submission(pred: DataFrame, spec: ProblemSpec, value: str = "pred") -> DataFrame:
    """``(id, target)``: value or probability, or the decoded class."""
    out: Column = F.col(value)
    if spec.problem_type == "multiclass":
        out = decode_probabilities(out, spec.labels)
    rows = pred
    name = spec.id or "id"
    if spec.id is None or spec.id not in pred.columns:
        rows = running_number(pred, name)
    return rows.select(name, out.alias(spec.target))
