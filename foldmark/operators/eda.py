"""Profiles, leak scans and the digest.

Each function returns a lazy table.  Columns are handled together: one
aggregate for all numeric statistics, one unpivot for all distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from foldmark.constants import (
    CORRELATION_TOP, DIGEST_ALERTS_TOP, DIGEST_CARDINALITY_TOP, DIGEST_MISSING_TOP,
    LEAK_CORRELATION, LEAK_MIN_LEVELS, LEAK_THRESHOLD, TARGET_CLASSES_SHOWN,
    TARGET_VALUES_SHOWN, TOP_VALUES,
)
from foldmark.functions.features import compact_text
from foldmark.functions.kinds import kinds, numeric_columns
from foldmark.functions.moments import adjusted_kurtosis, adjusted_skew
from foldmark.operators.unpivot import long_stats, long_values


def kind_table(df: DataFrame) -> DataFrame:
    """Kind and number of values of every column."""
    known = kinds(df)
    return long_stats(df, {c: {"kind": F.first(F.lit(k)), "n_values": F.count(F.col(c))}
                           for c, k in known.items()})


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)))


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or df.columns
    return long_stats(df, {c: {"missing_frac": _missing_stat(c)} for c in cols})


def _compact(df: DataFrame, c: str) -> Column:
    return compact_text(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)


def value_counts(df: DataFrame, columns: list[str] | None = None,
                 compact: bool = False) -> DataFrame:
    """``(column, value, n)`` of all non-null values: one shuffle for all.

    With ``compact`` long texts are told apart by digest.
    """
    cols = columns or df.columns
    return (long_values(df, {c: _compact(df, c) if compact else F.col(c) for c in cols}).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, columns: list[str] | None = None,
                    approximate: float | None = None, compact: bool = True) -> DataFrame:
    """Distinct non-null values per column.

    Exact by default; with ``approximate`` (a relative error) one pass of
    sketches without a shuffle of the values.
    """
    cols = columns or df.columns
    if approximate is not None:
        return long_stats(df, {c: {"n_unique": F.approx_count_distinct(c, approximate)}
                               for c in cols})
    found = (value_counts(df, cols, compact).groupBy("column")
             .agg(F.count(F.lit(1)).alias("n_unique")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(found, "column", "left")
            .select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique")))


def _missing_stat(c: str) -> Column:
    return F.round(F.avg(F.col(c).isNull().cast("int")), 4)


def _numeric_stat(c: str) -> dict[str, Column]:
    x = F.col(c).cast("double")
    return {"min": F.min(x), "max": F.max(x), "mean": F.avg(x),
            "std": F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))),
            "skew": adjusted_skew(x),
            "zeros_frac": F.round(F.avg((x == 0).cast("int")), 4)}


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    return long_stats(df, {c: _numeric_stat(c) for c in cols})


def top_values(df: DataFrame, columns: list[str] | None = None,
               top: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of text and bool columns.

    Ties go by value, those of long texts by length and digest: texts are
    counted by digest, and only the few that come out on top are fetched.
    """
    cols = columns or [c for c, k in kinds(df).items() if k in ("categorical", "bool")]
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    best = (value_counts(df, cols, compact=True).withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= top))
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return best.select("column", "value", "n", "place")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _compact(df, c).alias("value"),
                               F.col(f"`{c}`").alias("whole")) for c in texts])
    long = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.length("whole") > 64)
    # at most ``top`` rows per column are broadcast
    whole = (long.join(F.broadcast(best.select("column", "value")), ["column", "value"])
             .groupBy("column", "value").agg(F.min("whole").alias("whole")))
    return best.join(F.broadcast(whole), ["column", "value"], "left").select(
        "column", F.coalesce("whole", "value").alias("value"), "n", "place")


def high_cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or [c for c, k in kinds(df).items() if k in ("categorical", "bool")]
    rows = df.agg(F.count(F.lit(1)))
    return distinct_counts(df, cols).select(
        "column", "n_unique", (F.col("n_unique") > rows.scalar() * 0.5).alias("high_cardinality"))


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """``(stat, value)``: class counts, null included, or range and shape."""
    counts = df.groupBy(F.col(target).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.filter(F.col("level").isNotNull()).limit(TARGET_CLASSES_SHOWN + 1).count()
    if levels <= TARGET_CLASSES_SHOWN:
        label = F.coalesce(F.col("level").cast("string"), F.lit("null"))
        return (counts.select(label.alias("stat"), F.col("n").cast("double").alias("value"))
                .orderBy(F.desc("value"), "stat").limit(TARGET_VALUES_SHOWN))
    x = F.col(target).cast("double")
    row = df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                 adjusted_skew(x).alias("skew"))
    return row.unpivot([], ["min", "max", "mean", "skew"], "stat", "value")


def profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Everything above as one long table ``(column, kind, stat, value)``.

    Values are strings, so that counts, fractions and top values share it.
    One scan for all plain aggregates, one shuffle for the values of the
    numeric columns, and one for those of the others, which their distinct
    counts and top values share.
    """
    known = kinds(df)
    kind_of = F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]),
                           F.col("column"))
    numbers = numeric_columns(df)
    texts = [c for c, k in known.items() if k in ("categorical", "bool")]

    plain = {("", "n_rows"): F.count(F.lit(1)), ("", "n_cols"): F.first(F.lit(len(known)))}
    for c in known:
        plain[c, "missing_frac"] = _missing_stat(c)
    for c in numbers:
        plain.update({(c, s): x for s, x in _numeric_stat(c).items()})
    row = df.agg(*[x.alias(f"_{i}") for i, x in enumerate(plain.values())])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"),
                               F.col(f"_{i}").cast("string").alias("value"))
                      for i, (c, s) in enumerate(plain)])
    parts = [row.select(F.explode(cells).alias("s")).select("s.*")]

    others = [c for c in known if c not in texts]
    rows = df.agg(F.count(F.lit(1)))
    for cols in filter(None, (others, texts)):
        unique = F.col("n_unique").cast("string")
        parts.append(distinct_counts(df, cols).select(
            "column", F.lit("n_unique").alias("stat"), unique.alias("value")))
    if texts:
        parts.append(distinct_counts(df, texts).select(
            "column", F.lit("high_cardinality").alias("stat"),
            (F.col("n_unique") > rows.scalar() * 0.5).cast("string").alias("value")))
        parts.append(top_values(df, texts).select(
            "column", F.concat(F.lit("top:"), F.col("value")).alias("stat"),
            F.col("n").cast("string").alias("value")))
    if target:
        parts.append(target_profile(df, target).select(
            F.lit(target).alias("column"), F.concat(F.lit("target:"), F.col("stat")).alias("stat"),
            F.col("value").cast("string").alias("value")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.filter(F.col("value").isNotNull()).select(
        "column", F.coalesce(kind_of, F.lit("table")).alias("kind"), "stat", "value")


# -- relation to the target ----------------------------------------------------

def target_correlation(df: DataFrame, target: str,
                       columns: list[str] | None = None) -> DataFrame:
    """|Pearson| of each numeric column with the target, over complete pairs."""
    cols = columns or [c for c in numeric_columns(df) if c != target]
    y = F.col(target).cast("double")
    return long_stats(df, {c: {"abs_corr": F.abs(F.corr(F.col(c).cast("double"), y))}
                           for c in cols})


def correlation_top(df: DataFrame, target: str, top: int = CORRELATION_TOP) -> DataFrame:
    return (target_correlation(df, target).filter(F.col("abs_corr").isNotNull())
            .orderBy(F.desc("abs_corr"), "column").limit(top))


def leak_by_correlation(df: DataFrame, target: str,
                        limit: float = LEAK_CORRELATION) -> DataFrame:
    """Numeric columns almost collinear with a numeric target of > 2 values."""
    found = target_correlation(df, target).filter(F.col("abs_corr") > limit)
    span = (df.select(F.col(target).alias("y")).filter(F.col("y").isNotNull())
            .distinct().limit(3).agg(F.count(F.lit(1))))
    return found.filter(span.scalar() > 2)


def leak_by_dependency(df: DataFrame, target: str, threshold: float = LEAK_THRESHOLD,
                       columns: list[str] | None = None) -> DataFrame:
    """Columns nearly all of whose values occur with one target only.

    min(y) = max(y) decides "one target" for numbers, so no distinct sets are
    kept; the pairs with a text target are combined first, as keys.
    """
    cols = columns or [c for c in df.columns if c != target]
    rows = (long_values(df, cols, keep={"_y": F.col(target)})
            .filter(F.col("value").isNotNull()))
    if isinstance(df.schema[target].dataType, T.StringType):
        levels = (rows.groupBy("column", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("column", "value").agg(F.count("_y").alias("targets")))
        single = (F.col("targets") <= 1).cast("int")
    else:
        levels = rows.groupBy("column", "value").agg(F.min("_y").alias("lo"),
                                                     F.max("_y").alias("hi"))
        single = F.coalesce((F.col("lo") == F.col("hi")).cast("int"), F.lit(1))
    return (levels.groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_levels"), F.avg(single).alias("single_share"))
            .filter((F.col("single_share") > threshold)
                    & (F.col("n_levels") > LEAK_MIN_LEVELS)))


def leakage_scan(df: DataFrame, target: str, threshold: float = LEAK_THRESHOLD) -> DataFrame:
    """``(column, reason, value)`` of both scans."""
    parts = [leak_by_dependency(df, target, threshold).select(
        "column", F.lit("single target per value").alias("reason"),
        F.col("single_share").alias("value"))]
    if isinstance(df.schema[target].dataType, T.NumericType) \
            and len(numeric_columns(df)) > 1:
        parts.append(leak_by_correlation(df, target).select(
            "column", F.lit("correlation").alias("reason"), F.col("abs_corr").alias("value")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


# -- digest --------------------------------------------------------------------

def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, all columns equal.

    Grouped by the full row, long texts by digest, so equal rows are combined
    before the shuffle and no long text is moved.
    """
    groups = df.groupBy(*[_compact(df, c).alias(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def digest_missing(df: DataFrame, above: float = 0.0, top: int = DIGEST_MISSING_TOP) -> DataFrame:
    return (missing(df).filter(F.col("missing_frac") > above)
            .orderBy(F.desc("missing_frac"), "column").limit(top))


def digest_cardinality(df: DataFrame, top: int = DIGEST_CARDINALITY_TOP) -> DataFrame:
    return distinct_counts(df).orderBy(F.desc("n_unique"), "column").limit(top)


def digest_target(df: DataFrame, target: str) -> DataFrame:
    x = F.col(target).cast("double")
    stats = df.agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
                   F.stddev_samp(x).alias("std"), adjusted_skew(x).alias("skewness"),
                   adjusted_kurtosis(x).alias("kurtosis"))
    unique = (df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.count(target).alias("n_unique")))
    return stats.select(F.lit(target).alias("column"), unique.scalar().alias("n_unique"), "*")


# Thresholds of our own for the alerts.
ALERT_SKEW = 20.0
ALERT_ZEROS = 0.1
ALERT_MISSING = 0.05


def digest_alerts(df: DataFrame, top: int = DIGEST_ALERTS_TOP) -> DataFrame:
    """``(alert, column)``: UNIQUE, CONSTANT, MISSING, SKEWED, ZEROS.

    SKEWED: |adjusted skew| above 20; ZEROS: above 10% zeros; MISSING: above
    5% nulls; UNIQUE: all rows distinct; CONSTANT: one value.
    """
    rows = df.agg(F.count(F.lit(1)))
    stats = numeric_stats(df) if numeric_columns(df) else None
    base = distinct_counts(df).join(missing(df), "column")
    if stats is not None:
        base = base.join(stats.select("column", "skew", "zeros_frac"), "column", "left")
    else:
        base = base.withColumns({"skew": F.lit(None).cast("double"),
                                 "zeros_frac": F.lit(None).cast("double")})

    def flag(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    flags = F.array_compact(F.array(
        flag("UNIQUE", F.col("n_unique") == rows.scalar()),
        flag("CONSTANT", F.col("n_unique") == 1),
        flag("MISSING", F.col("missing_frac") > ALERT_MISSING),
        flag("SKEWED", F.abs("skew") > ALERT_SKEW),
        flag("ZEROS", F.col("zeros_frac") > ALERT_ZEROS)))
    return (base.select(F.explode(flags).alias("alert"), "column")
            .orderBy("alert", "column").limit(top))
