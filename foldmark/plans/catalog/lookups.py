"""Lookups and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.functions.features import log1p_floor
from foldmark.operators import journal as journal_ops
from foldmark.operators.encode import fit_levels
from foldmark.operators.slots import Slots
from foldmark.operators.evaluate import importance_mean
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded, union_sql


@query("map_lookup", f"""WITH {fx.ORDERS}, m AS (
  SELECT nation, count(*) AS n FROM orders_base WHERE fold <> 0 GROUP BY nation)
SELECT order_id, coalesce(n, 0) AS nation_count FROM orders_base LEFT JOIN m USING (nation)""")
def map_lookup(spark, folder):
    """Counts learned on four folds, looked up for all rows."""
    rows = fx.orders_base(spark, folder)
    encoder = fit_levels(rows.filter(F.col("fold") != 0), ["nation"], null_level=False)
    return encoder.transform(rows, "order_id", count="_count").select("order_id", "nation_count")


@query("map_lookup_foldaware", f"""WITH {fx.ORDERS},
lv AS (SELECT order_id, fold, y, coalesce(priority, '__nan__') AS lv FROM orders_base),
s AS (SELECT lv, fold, sum(y) AS s, count(*) AS n FROM lv GROUP BY lv, fold),
t AS (SELECT lv, sum(s) AS s, sum(n) AS n FROM s GROUP BY lv),
g AS (SELECT k AS fold, avg(y) AS g FROM lv JOIN range(0, 5) r(k) ON fold <> k GROUP BY k)
SELECT order_id, round((t.s - s.s + 20 * g) / (t.n - s.n + 20), 6) AS priority_te
FROM lv JOIN s USING (lv, fold) JOIN t USING (lv) JOIN g USING (fold)""")
def map_lookup_foldaware(spark, folder):
    rows = fx.orders_base(spark, folder)
    encoder = fit_levels(rows, ["priority"], F.col("y"), Slots("fold", fx.FOLDS))
    out = encoder.transform(rows, "order_id", -1, target="_te")
    return rounded(out.select("order_id", "priority_te"))


_IMPORTANCE = f"""WITH {fx.LINES}, imp AS ({union_sql([
    f"SELECT fold, '{c}' AS feature, abs(corr({c}, price)) AS importance FROM lines GROUP BY fold"
    for c in ("quantity", "tax", "line", "discount")])})
SELECT feature, round(avg(importance), 6) AS importance FROM imp GROUP BY feature"""


def fold_importance(spark, folder):
    """``(fold, feature, importance)``: |correlation| with the price by fold."""
    names = ["quantity", "tax", "line", "discount"]
    grouped = fx.lines(spark, folder).groupBy("fold").agg(
        *[F.abs(F.corr(c, "price")).alias(c) for c in names])
    return grouped.unpivot(["fold"], names, "feature", "importance")


@query("align_importances", _IMPORTANCE)
def align_importances(spark, folder):
    return rounded(importance_mean(fold_importance(spark, folder), None))


@query("align_rows", f"""WITH {fx.ORDERS}
SELECT order_id, round(ln(1 + greatest(price, 0)), 6) AS log_price,
       CAST(acctbal IS NULL AS INTEGER) AS acctbal_isna FROM orders_base""")
def align_rows(spark, folder):
    """Computed columns stay beside their key: nothing is sorted back."""
    return rounded(fx.orders_base(spark, folder).select(
        "order_id", log1p_floor(F.col("price")).alias("log_price"),
        F.col("acctbal").isNull().cast("int").alias("acctbal_isna")))


RATES = "rates(rate_model, rate_in, rate_out) AS (VALUES " + ", ".join(
    f"('{m}', {i}, {o})" for m, i, o in journal_ops.RATE_CARD) + ")"
NORMAL = """CASE WHEN starts_with(lower(trim(model)), 'gpt://')
  THEN split_part(lower(trim(model)), '/', 4) ELSE split_part(lower(trim(model)), '/', 1) END"""


@query("rate_join", f"""WITH {fx.JOURNAL}, {RATES},
u AS (SELECT run, iter, {NORMAL} AS rate_model FROM journal WHERE event = 'TOKEN_USAGE')
SELECT run, iter, rate_model, CAST(rate_in AS DOUBLE) AS rate_in,
       CAST(rate_out AS DOUBLE) AS rate_out FROM u LEFT JOIN rates USING (rate_model)""")
def rate_join(spark, folder):
    usage = fx.journal(spark, folder).filter(F.col("event") == "TOKEN_USAGE")
    return journal_ops.with_rates(usage).select("run", "iter", "rate_model", "rate_in", "rate_out")
