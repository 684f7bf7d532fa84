"""Running features and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.functions.features import product
from foldmark.operators import journal as journal_ops
from foldmark.operators.evaluate import importance_mean
from foldmark.operators.sequence import event_history
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded
from foldmark.plans.catalog.lookups import fold_importance

HISTORY = """w AS (SELECT *, event_type = 'purchase' AS hit,
    sum(CAST(event_type = 'purchase' AS BIGINT)) OVER s AS cum, row_number() OVER s AS rn
    FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, cum ORDER BY ts, event_id) - 1 AS since FROM w)"""


def history(spark, folder):
    """Purchases so far and events since the last one, per user."""
    return event_history(fx.events(spark, folder), ["user_id"], "ts", "event_id",
                         F.col("event_type") == "purchase")


@query("w_cum_count", f"WITH {HISTORY} SELECT event_id, user_id, CAST(cum AS BIGINT) AS cum_count FROM h")
def w_cum_count(spark, folder):
    return history(spark, folder).select("event_id", "user_id", "cum_count")


@query("w_since_last", f"WITH {HISTORY} SELECT event_id, user_id, since AS since_last FROM h")
def w_since_last(spark, folder):
    return history(spark, folder).select("event_id", "user_id", "since_last")


@query("w_cum_cross", f"WITH {HISTORY} SELECT event_id, round(cum * value, 4) AS cum_x_value FROM h")
def w_cum_cross(spark, folder):
    return rounded(history(spark, folder).select(
        "event_id", product(F.col("cum_count"), F.col("value")).alias("cum_x_value")), 4)


@query("stable_sort", """
SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders
ORDER BY o_orderstatus, o_orderpriority, o_orderkey""")
def stable_sort(spark, folder):
    """Sorted by two keys; the id settles ties as arrival order would."""
    return (spark.read.parquet(f"{folder}/orders.parquet")
            .select("o_orderstatus", "o_orderpriority", "o_orderkey")
            .orderBy("o_orderstatus", "o_orderpriority", "o_orderkey"))


@query("topk_importance", f"""WITH {fx.LINES}, imp AS (
  SELECT fold, 'quantity' AS feature, abs(corr(quantity, price)) AS importance FROM lines GROUP BY fold
  UNION ALL SELECT fold, 'tax', abs(corr(tax, price)) FROM lines GROUP BY fold
  UNION ALL SELECT fold, 'line', abs(corr(line, price)) FROM lines GROUP BY fold
  UNION ALL SELECT fold, 'discount', abs(corr(discount, price)) FROM lines GROUP BY fold)
SELECT feature, round(avg(importance), 6) AS importance FROM imp GROUP BY feature
ORDER BY avg(importance) DESC, feature LIMIT 2""")
def topk_importance(spark, folder):
    return rounded(importance_mean(fold_importance(spark, folder), 2))


@query("topk_tail", f"""WITH {fx.JOURNAL}
SELECT run, event, iter, t FROM journal WHERE event NOT IN ('TOOL_CALL', 'TOOL_RESULT', 'TOKEN_USAGE')
ORDER BY t DESC, iter DESC, event DESC, run DESC LIMIT 5""")
def topk_tail(spark, folder):
    kept = journal_ops.without_noise(fx.journal(spark, folder))
    return journal_ops.tail(kept, ["t", "iter", "event", "run"], 5).select("run", "event", "iter", "t")
