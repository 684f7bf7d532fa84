"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foldmark.constants import SAMPLE_SIZE, SAMPLE_THRESHOLD, SEED
from foldmark.functions.hashing import seeded_md5


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL mean the same thing: keep only NULL; -0.0 becomes 0.0."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    zero = {f.name: F.lit(0.0).cast(f.dataType) for f in df.schema.fields if f.name in floats}
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`") + zero[c])
                           for c in floats}) if floats else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))


def read_csv(spark: SparkSession, path: str | list[str],
             schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. A schema saves the extra pass that inference costs."""
    reader = spark.read.option("header", True)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return nan_to_null(reader.csv(path))


def read_texts(spark: SparkSession, paths: list[str]) -> str:
    """Description files joined by blank lines, in the order given.

    These are hand-written task texts: one small string each.
    """
    parts = [spark.read.text(p, wholetext=True).first() for p in paths]
    return join_texts([row["value"] if row else "" for row in parts])


def join_texts(parts: list[str]) -> str:
    return "\n\n".join(parts)


def join_text_columns(cols: list[Column]) -> Column:
    return F.concat_ws("\n\n", *cols)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows by a key: a table has no row order of its own."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, size: int = SAMPLE_SIZE,
                  threshold: int = SAMPLE_THRESHOLD, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows, in hash order, once a table passes ``threshold``.

    Rows whose hash exceeds a cut that surely keeps ``size`` rows are filtered
    before the sort, so only about ``size`` rows are ordered however large the
    table is.
    """
    n = df.count()
    if n <= threshold:
        return df
    order = seeded_md5(F.col(key), seed)
    share = (size + 8.0 * size ** 0.5 + 64) / n
    candidates = df
    if share < 0.5:
        top = format(min(int(share * 2 ** 32), 2 ** 32 - 1), "08x")
        narrowed = df.filter(F.substring(order, 1, 8) <= top)
        if narrowed.count() >= size:
            candidates = narrowed
    return (candidates.withColumn("_order", order)
            .orderBy("_order", key).limit(size).drop("_order"))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").parquet(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists",
               partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
    return path
