"""The model, cross-validation and submissions.

A whole boosted model has no SQL form: those queries return what must hold for
it whatever the trees, row by row where there are rows.  One tree of one level
does have a SQL form, and is compared value by value.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldmark.functions.labels import label_index
from foldmark.operators import metrics
from foldmark.operators.evaluate import importance_mean
from foldmark.operators.framing import ProblemSpec
from foldmark.operators.model import ModelParams, fit_model, prepare
from foldmark.operators.submission import submission
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded, union_sql
from foldmark.plans.contract import KEY
from foldmark.plans.evaluation import cross_validate, refit_predict
from foldmark.plans.recipes import Curriculum, PassThrough

# Depth, rate and folds are the defaults; every round is six passes.
PARAMS = ModelParams(rounds=10)
# The whole model: up to 2,000 rounds, ended by the loss of rows held out.
WHOLE = ModelParams()
FEATURES = ["acctbal", "order_year", "price", "segment", "priority"]


def _model_rows(spark, folder):
    return fx.orders_base(spark, folder).select("order_id", "fold", F.col("y").cast("double"),
                                                *FEATURES)


def _fitted(spark, folder):
    rows = _model_rows(spark, folder)
    return rows, fit_model(rows.filter("fold <> 0"), FEATURES, "y", "binary", PARAMS, key="order_id")


@query("model_fit", """SELECT 10 AS n_trees, 5 AS n_features, true AS within_depth""")
def model_fit(spark, folder):
    """Trees after fitting on four folds."""
    _, model = _fitted(spark, folder)
    return spark.createDataFrame(
        [(model.n_trees, len(model.features), model.n_leaves <= model.n_trees << PARAMS.depth)],
        "n_trees int, n_features int, within_depth boolean")


@query("model_prep", f"""WITH {fx.ORDERS}
SELECT order_id, segment, coalesce(priority, '__nan__') AS priority, order_year FROM orders_base""")
def model_prep(spark, folder):
    return prepare(fx.orders_base(spark, folder).select(
        "order_id", "segment", "priority", "order_year")).drop("_in")


@query("model_predict", f"""WITH {fx.ORDERS}, r AS (SELECT * FROM orders_base WHERE fold = 0)
SELECT order_id, CAST(y AS DOUBLE) AS y, true AS probability FROM r""")
def model_predict(spark, folder):
    """Every row of the fold kept out has a probability."""
    rows, model = _fitted(spark, folder)
    return model.predict(rows.filter("fold = 0")).select(
        "order_id", "y", F.col("pred").between(0, 1).alias("probability"))


@query("model_importance", union_sql([f"SELECT '{c}' AS feature, true AS share, 1.0 AS total" for c in FEATURES]))
def model_importance(spark, folder):
    """Shares of the gain, of every feature."""
    _, model = _fitted(spark, folder)
    found = model.importance(spark)
    whole = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    return found.join(F.broadcast(whole)).select(
        "feature", F.col("importance").between(0, 1).alias("share"), "total")


# -- one tree of one level --------------------------------------------------------------

STUMP = ModelParams(rounds=1, depth=1, rate=1.0, subsample=1.0)
STUMP_FEATURES = ["quantity", "discount", "tax", "line"]
FLAGS = ["A", "N", "R"]


def _stump_sql(outputs: list[tuple[str, str]]) -> str:
    """The best split of the line items; ``outputs`` are gradient and curvature
    of each output at the starting score."""
    k = range(len(outputs))
    slopes = ", ".join(f"{g} AS g{i}, {h} AS h{i}" for i, (g, h) in enumerate(outputs))
    sums = ", ".join(f"sum(g{i}) AS g{i}, sum(h{i}) AS h{i}" for i in k)
    below = ", ".join(f"sum({x}{i}) OVER w AS l{x}{i}" for i in k for x in "gh")
    above = ", ".join(f"sum({x}{i}) OVER (PARTITION BY pos) - sum({x}{i}) OVER w AS r{x}{i}"
                      for i in k for x in "gh")
    worth = " + ".join(
        f"lg{i} * lg{i} / (lh{i} + 3) + rg{i} * rg{i} / (rh{i} + 3) "
        f"- (lg{i} + rg{i}) * (lg{i} + rg{i}) / (lh{i} + rh{i} + 3)" for i in k)
    out = ", ".join(f"round(-{s}g{i} / ({s}h{i} + 3), 6) AS {n}_{i}"
                    for i in k for s, n in (("l", "below"), ("r", "above")))
    values = union_sql([f"SELECT {pos} AS pos, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, s.* FROM s"
                        for pos, c in enumerate(STUMP_FEATURES)])
    return f"""WITH {fx.LINES}, facts AS (
  SELECT avg(CAST(flag = 'A' AS INTEGER)) AS p, avg(price) AS m,
    (count(*) FILTER (flag = 'A') + 1) / (count(*) + 3.0) AS p0,
    (count(*) FILTER (flag = 'N') + 1) / (count(*) + 3.0) AS p1,
    (count(*) FILTER (flag = 'R') + 1) / (count(*) + 3.0) AS p2 FROM lines
), s AS (SELECT quantity, discount, tax, line, {slopes} FROM lines, facts
), long AS ({values}
), cells AS (SELECT pos, feature, x, {sums} FROM long GROUP BY pos, feature, x
), cut AS (SELECT pos, feature, x, {below}, {above} FROM cells
  WINDOW w AS (PARTITION BY pos ORDER BY x NULLS FIRST ROWS UNBOUNDED PRECEDING)
), judged AS (SELECT *, {worth} AS gain FROM cut)
SELECT feature, x AS threshold, round(gain, 3) AS gain, {out} FROM judged
ORDER BY gain DESC, pos, x NULLS FIRST LIMIT 1"""


def _stump(spark, folder, problem, label):
    rows = fx.lines(spark, folder).withColumn("target", label)
    model = fit_model(rows, STUMP_FEATURES, "target", problem, STUMP, n_classes=3, key="l_orderkey").boosted
    tree = model.trees[0]
    f, b = tree.features[0], tree.bins[0]
    row = {"feature": STUMP_FEATURES[f], "threshold": float(model.edges[f][b - 1]) if b else None,
           "gain": tree.gains[0]}
    for i in range(tree.values.shape[1]):
        row |= {f"below_{i}": float(tree.values[0, i]), f"above_{i}": float(tree.values[1, i])}
    names = [n for n in row if n not in ("feature", "threshold")]
    return rounded(spark.createDataFrame([tuple(row.values())], "feature string, threshold double, "
                                         + ", ".join(f"{n} double" for n in names)), gain=3)


@query("model_stump", _stump_sql([("p - CAST(flag = 'A' AS INTEGER)", "p * (1 - p)")]))
def model_stump(spark, folder):
    """The first split of a binary model: where, what it gains, and both leaves."""
    return _stump(spark, folder, "binary", (F.col("flag") == "A").cast("double"))


@query("model_stump_regression", _stump_sql([("m - price", "1.0")]))
def model_stump_regression(spark, folder):
    return _stump(spark, folder, "regression", F.col("price"))


@query("model_stump_multiclass", _stump_sql(
    [(f"p{i} - CAST(flag = '{c}' AS INTEGER)", f"p{i} * (1 - p{i})") for i, c in enumerate(FLAGS)]))
def model_stump_multiclass(spark, folder):
    """One split for all classes, with a value for each in both leaves."""
    return _stump(spark, folder, "multiclass", label_index(F.col("flag"), FLAGS))


# -- cross-validation and refit ---------------------------------------------------------------

def _evaluated(spark, folder, solution, target="y", params=PARAMS):
    spec = fx.order_spec(spark, folder, target, f"Predict the target column: {target}")
    result = cross_validate(solution, spec, metrics.select_metric(
        spec.task_text, spec.problem_type), params=params)
    if not result.ok:
        raise RuntimeError(result.error)
    return result


def _cv_sql(unit: str = "0.8") -> str:
    return f"""WITH {fx.ORDERS}
SELECT 5 AS n_folds, true AS is_mean, true AS in_range, count(*) AS n_predictions FROM orders_base
WHERE {fx.sql_number('order_id').replace('42|', '7|')} / 4294967296.0 < {unit}"""


def _cv_facts(result, in_range):
    mean = F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + x) / F.size("fold_scores")
    rows = result.oof.agg(F.count("pred").alias("n_predictions"))
    return result.summary.join(F.broadcast(rows)).select(
        F.size("fold_scores").alias("n_folds"), (F.abs(mean - F.col("score")) < 1e-9).alias("is_mean"),
        in_range.alias("in_range"), "n_predictions")


@query("cv_fit_predict", _cv_sql())
def cv_fit_predict(spark, folder):
    """AUC over five folds for the second recipe: its mean, and every row predicted.

    Statuses do not depend on the features here, so chance is what leak-free
    features reach; a leak would lie above.
    """
    return _cv_facts(_evaluated(spark, folder, Curriculum(2), params=WHOLE), F.col("score").between(0.4, 0.6))


@query("cv_multiclass", _cv_sql())
def cv_multiclass(spark, folder):
    """Three classes: the log loss over five folds is about that of their shares at most."""
    return _cv_facts(_evaluated(spark, folder, PassThrough(), "status"),
                     F.col("score").between(0.0, math.log(3) * 1.05))


@query("oof", f"""WITH {fx.ORDERS}
SELECT order_id, 1 AS n_predictions FROM orders_base
WHERE {fx.sql_number('order_id').replace('42|', '7|')} / 4294967296.0 < 0.8""")
def oof(spark, folder):
    """Every training row is predicted exactly once."""
    result = _evaluated(spark, folder, PassThrough())
    return result.oof.groupBy(F.col(KEY).alias("order_id")).agg(
        F.count("pred").cast("int").alias("n_predictions"))


@query("importance_mean", union_sql([
    f"SELECT '{c}' AS feature, true AS share, 1.0 AS total" for c in ("acctbal", "order_year", "segment", "nation", "priority")]))
def importance(spark, folder):
    """Mean over the folds: shares that add up to one, of every feature."""
    found = importance_mean(_evaluated(spark, folder, PassThrough()).importance.withColumn("fold", F.lit(0)))
    whole = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    return found.join(F.broadcast(whole)).select(
        "feature", F.col("importance").between(0, 1).alias("share"), "total")


@query("refit_predict", f"""WITH {fx.ORDERS}
SELECT order_id, true AS in_range FROM orders_base
WHERE {fx.sql_number('order_id').replace('42|', '7|')} / 4294967296.0 >= 0.8""")
def refit(spark, folder):
    """The full refit: test rows, with regression output clipped to the training range."""
    spec = fx.order_spec(spark, folder, "price", "target: price")
    low, high = spec.train.agg(F.min("price"), F.max("price")).first()
    pad = 0.02 * (high - low) + 1e-9
    return refit_predict(Curriculum(4), spec, PARAMS).select(
        "order_id", F.col("pred").between(low - pad, high + pad).alias("in_range"))


@query("submission", f"""WITH {fx.CLASSED}, one AS (
  SELECT CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS flag FROM classed)
SELECT flag, count(*) AS n, (SELECT count(*) FROM one) AS ids, 0 AS first_id,
  (SELECT count(*) - 1 FROM one) AS last_id FROM one GROUP BY flag""")
def submit(spark, folder):
    """Decoded classes; the table has no id, so rows are numbered from 0."""
    rows = fx.classed(spark, folder).select("truth", "probs")
    spec = ProblemSpec("", "", "flag", None, "multiclass", 3, ["A", "N", "R"], rows, rows)
    table = submission(rows, spec, "probs")
    ids = table.agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"),
                    F.max("id").alias("last_id"))
    counts = table.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    facts = ids.first()
    return counts.select("flag", "n", *[F.lit(facts[c]).cast("bigint").alias(c)
                                        for c in ("ids", "first_id", "last_id")])
