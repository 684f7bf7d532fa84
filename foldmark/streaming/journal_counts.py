"""Event counts per run in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldmark.constants import JOURNAL_TIME_FORMAT


def windowed_counts(journal: DataFrame, window: str = "10 minutes",
                    late: str = "1 hour") -> DataFrame:
    """Counts by run, event and window; the same on a table or a stream.

    On a stream in append mode a window comes out once the watermark has
    passed its end, and its state is dropped then.
    """
    timed = journal.withColumn("_at", F.to_timestamp("t", JOURNAL_TIME_FORMAT))
    if journal.isStreaming:
        timed = timed.withWatermark("_at", late)
    return (timed.groupBy(F.window("_at", window).alias("w"), "run", "event")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("run", "event", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n"))
