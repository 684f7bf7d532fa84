"""Running a stream over what is there, and reading the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldmark.session import scratch_path


def source_table(spark: SparkSession, folder: str, name: str,
                 files_per_trigger: int = 64) -> DataFrame:
    """A table folder, or one file of a folder, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def _drained(stream: DataFrame, name: str, mode: str) -> tuple[str, int]:
    """Process all available input: where the table and the progress lie, and
    how many rows came behind the watermark and were dropped.

    Progress and state are kept in the shared folder, so a restart resumes.
    The counts come from the query's progress, which is kept for every batch.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, 1_000_000)
    try:
        query = (stream.writeStream.outputMode(mode).format("parquet")
                 .option("path", f"{base}/data").option("checkpointLocation", f"{base}/progress")
                 .trigger(availableNow=True).start())
    finally:
        spark.conf.set(kept, before)
    query.awaitTermination()
    return base, sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def drain_counted(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, int]:
    """Process all available input into a parquet table and read it back; and
    how many rows came behind the watermark and were dropped."""
    base, late = _drained(stream, name, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/data"), late


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The table that :func:`drain_counted` leaves."""
    return drain_counted(stream, name, mode)[0]


def drain_whole(stream: DataFrame, name: str, closed: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Every row of a finite input: those that the watermark has passed, and
    those still open at its end, which ``closed`` makes from the checkpoint.

    A row that was dropped as late would be missing, so that is an error.
    """
    spark = stream.sparkSession
    base, late = _drained(stream, name, "append")
    if late:
        raise ValueError(f"{late} rows came behind the watermark")
    done = spark.read.schema(stream.schema).parquet(f"{base}/data")
    return done.unionByName(closed(spark, f"{base}/progress"))
