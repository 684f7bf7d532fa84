"""The experiment journal: one JSON object per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldmark.session import scratch_path
from foldmark.sources.tables import nan_to_null, write_json

JOURNAL_SCHEMA = (
    "run string, event string, t string, iter int, metric string, ok boolean, "
    "score double, std double, folds array<double>, n_features int, seconds double, "
    "accepted boolean, msg string, name string, args_preview string, content_len int, "
    "model string, input bigint, output bigint, total bigint, cost_rub double")


def _reader(reader, strict: bool):
    return (reader.schema(JOURNAL_SCHEMA).option("allowNonNumericNumbers", True)
            .option("mode", "FAILFAST" if strict else "DROPMALFORMED"))


def read_journal(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Journal rows; blank lines are skipped, bad lines dropped or, when
    strict, an error.  A failed score is written as NaN and read as null."""
    rows = _reader(spark.read, strict).json(path)
    return nan_to_null(rows.filter(F.col("event").isNotNull()) if not strict else rows)


def stream_journal(spark: SparkSession, path: str) -> DataFrame:
    return _reader(spark.readStream, False).json(path)


def follow_journal(spark: SparkSession, path: str, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Take in all new lines of a journal folder: its rows so far, and the lines
    that are none.

    Lines are read as a file stream, whose progress is kept under ``place``;
    called again, only new files are read.  Rows and bad lines are written per
    batch, and a batch that is done again replaces what it wrote before.
    """
    place = place or scratch_path(spark, "journal")

    def take(batch: DataFrame, number: int) -> None:
        parsed = batch.filter(F.trim("value") != "").select(
            "value", F.from_json("value", JOURNAL_SCHEMA + ", _bad string", {
                "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
                "allowNonNumericNumbers": "true"}).alias("r"))
        bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.event").isNull()
        # parsed and written once, good and bad lines in folders of their own
        good = nan_to_null(parsed.select(bad.alias("bad"), "value", "r.*").drop("_bad"))
        (good.withColumn("value", F.when(F.col("bad"), F.col("value")))
         .write.mode("overwrite").partitionBy("bad").parquet(f"{place}/lines/batch={number}"))

    (spark.readStream.text(path).writeStream.foreachBatch(take).trigger(availableNow=True)
     .option("checkpointLocation", f"{place}/progress").start().awaitTermination())
    lines = spark.read.schema("value string, " + JOURNAL_SCHEMA + ", batch int, bad boolean").parquet(
        f"{place}/lines")
    return lines.filter("NOT bad").drop("value", "batch", "bad"), lines.filter("bad").select("value")


def append_journal(rows: DataFrame, path: str, by_run: bool = False) -> str:
    """Add events; with ``by_run`` a folder per run, so that one run is read
    without the rest."""
    return write_json(rows, path, mode="append", partition_by=["run"] if by_run else None)
