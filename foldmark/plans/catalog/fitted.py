"""Fitted statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import encode
from foldmark.operators.slots import Slots
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded, union_sql

NUMBERS = ["quantity", "price", "discount", "tax", "line"]
SLOTS = Slots("fold", fx.FOLDS)
# slot k leaves fold k out; the last slot, 5, leaves nothing out
EVERY_SLOT = range(fx.FOLDS + 1)
LEVELS = ["segment", "nation", "priority"]


def _small(spark, rows, schema):
    """A short list of fitted numbers as a table."""
    return spark.createDataFrame(rows, schema)


def slots_sql(columns, body: str, table: str) -> str:
    """SQL per column and slot; ``{c}`` is the column, ``{w}`` the filter."""
    return union_sql([
        f"SELECT '{c}' AS \"column\", {k} AS slot, {body.format(c=c, w=f'WHERE fold <> {k}')} FROM {table}"
        for c in columns for k in EVERY_SLOT])


@query("fit_median", f"WITH {fx.LINES} " + slots_sql(
    NUMBERS, "round(median({c}) FILTER ({w}), 6) AS median", "lines"))
def fit_median(spark, folder):
    got = encode.fit_medians(fx.lines(spark, folder), NUMBERS, SLOTS)
    return rounded(_small(spark, [(c, k, v) for c, vs in got.items() for k, v in enumerate(vs)],
                          "column string, slot int, median double"))


_DOC_NUMBERS = ["n_chars", "quality", "toxic"]
_DOC_FOLDS = f"{fx.DOCS}, folded AS (SELECT *, {fx.sql_fold('doc_id')} AS fold FROM docs)"


def _folded_docs(spark, folder):
    from foldmark.operators.folds import kfold
    return kfold(fx.docs(spark, folder), "doc_id", fx.FOLDS)


@query("fit_skewed", f"WITH {_DOC_FOLDS} " + slots_sql(
    _DOC_NUMBERS, "min({c}) FILTER ({w}) > 0 AND abs(skewness({c}) FILTER ({w})) > 1 AS is_skewed",
    "folded"))
def fit_skewed(spark, folder):
    moments = encode.fit_moments(_folded_docs(spark, folder), _DOC_NUMBERS, SLOTS)
    rows = [(c, k, c in encode.skewed_columns(moments, k))
            for c in _DOC_NUMBERS for k in EVERY_SLOT]
    return _small(spark, rows, "column string, slot int, is_skewed boolean")


def _level_sql(value: str, where: str = "true", null: str = "'__nan__'") -> str:
    return union_sql([f"""SELECT '{c}' AS feature, coalesce({c}, {null}) AS level, {value.format(c=c)} AS value
        FROM orders_base WHERE {where.format(c=c)} GROUP BY 2""" for c in LEVELS])


@query("fit_freq_norm", f"WITH {fx.ORDERS} " + _level_sql(
    "round(count(*) / (SELECT count(*) FROM orders_base), 6)"))
def fit_freq_norm(spark, folder):
    encoder = encode.fit_levels(fx.orders_base(spark, folder), LEVELS)
    share = F.element_at("counts", 1) / encoder.rows[-1]
    return rounded(encoder.levels.table.select("feature", "level", share.alias("value")))


@query("fit_freq_count", f"WITH {fx.ORDERS} " + _level_sql("count(*)", "{c} IS NOT NULL"))
def fit_freq_count(spark, folder):
    return encode.level_counts(fx.orders_base(spark, folder), {c: F.col(c) for c in LEVELS},
                               null_level=False).select("feature", "level", F.col("n").alias("value"))


def _te_sql(level: str, formula: str, where: str = "true") -> str:
    return f"""WITH {fx.ORDERS}, g AS (SELECT avg(y) AS g FROM orders_base),
    s AS (SELECT {level} AS level, count(*) AS n, sum(y) AS s FROM orders_base WHERE {where} GROUP BY 1)
    SELECT level, n, round({formula}, 6) AS te FROM s, g"""


@query("fit_te_weighted", _te_sql(
    "coalesce(priority, '__nan__')",
    "(n / (n + 20.0)) * (s / n) + (1 - n / (n + 20.0)) * g"))
def fit_te_weighted(spark, folder):
    return rounded(encode.smoothed_levels(fx.orders_base(spark, folder), "priority", F.col("y"), 20.0))


@query("fit_te_sum", _te_sql("priority", "(s + 10 * g) / (n + 10)", "priority IS NOT NULL"))
def fit_te_sum(spark, folder):
    return rounded(encode.smoothed_levels(fx.orders_base(spark, folder), "priority", F.col("y"),
                                          10.0, null_level=False))


@query("fit_te_interaction", _te_sql(
    "CAST(to_json([nation, coalesce(priority, '__nan__')]) AS VARCHAR)", "(s + 10 * g) / (n + 10)"))
def fit_te_interaction(spark, folder):
    rows = fx.orders_base(spark, folder).withColumn("pair", encode.composite("nation", "priority"))
    return rounded(encode.smoothed_levels(rows, "pair", F.col("y"), 10.0))


@query("fit_global_mean", f"WITH {fx.ORDERS} " + slots_sql(
    ["y"], "round(avg({c}) FILTER ({w}), 6) AS mean", "orders_base"))
def fit_global_mean(spark, folder):
    got = encode.global_means(fx.orders_base(spark, folder), F.col("y"), SLOTS)
    return rounded(_small(spark, [("y", k, v) for k, v in enumerate(got)],
                          "column string, slot int, mean double"))


@query("fit_range", f"WITH {fx.ORDERS} " + slots_sql(
    ["price"], "min({c}) FILTER ({w}) AS low, max({c}) FILTER ({w}) AS high", "orders_base"))
def fit_range(spark, folder):
    got = encode.target_range(fx.orders_base(spark, folder), F.col("price"), SLOTS)
    return _small(spark, [("price", k, lo, hi) for k, (lo, hi) in enumerate(got)],
                  "column string, slot int, low double, high double")


_WIDE = ["quantity", "price", "discount", "tax", "line", "l_orderkey"]


@query("fit_top_var", f"""WITH {fx.LINES}, v AS ({slots_sql(
    _WIDE, 'var_samp({c}) FILTER ({w}) AS v', 'lines')})
SELECT "column", slot, CAST(row_number() OVER (PARTITION BY slot ORDER BY v DESC, "column") AS INTEGER) AS place
FROM v QUALIFY place <= 5""")
def fit_top_var(spark, folder):
    moments = encode.fit_moments(fx.lines(spark, folder), _WIDE, SLOTS)
    rows = [(c, k, i + 1) for k in EVERY_SLOT
            for i, c in enumerate(encode.top_variance(moments, k))]
    return _small(spark, rows, "column string, slot int, place int")


@query("foldaware_stats", f"WITH {fx.ORDERS} " + union_sql([
    f"""SELECT '{c}' AS feature, coalesce({c}, '__nan__') AS level, k AS slot,
    count(*) FILTER (fold <> k) AS n, CAST(coalesce(sum(y) FILTER (fold <> k), 0) AS DOUBLE) AS y_sum
    FROM orders_base, range(0, 6) r(k) GROUP BY ALL""" for c in LEVELS]))
def foldaware_stats(spark, folder):
    table = encode.level_counts(fx.orders_base(spark, folder), {c: F.col(c) for c in LEVELS},
                                F.col("y"), SLOTS)
    slots = F.posexplode(F.arrays_zip("counts", "ysums"))
    return (table.select("feature", "level", slots.alias("slot", "s"))
            .select("feature", "level", F.col("slot").cast("bigint").alias("slot"),
                    F.col("s.counts").alias("n"), F.col("s.ysums").alias("y_sum")))
