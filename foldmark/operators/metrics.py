"""Metrics as grouped aggregates: one row per fold."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldmark.constants import DEFAULT_METRIC, LOGLOSS_CLIP, METRIC_PATTERNS
from foldmark.functions.labels import decode_binary, decode_probabilities
from foldmark.operators.quantiles import rough_cuts, with_bins
from foldmark.session import materialize

EPSILON = 2.220446049250313e-16
PAIRS_PER_PIECE = 2_000_000
MAX_PIECES = 16_384


@dataclass(frozen=True)
class Metric:
    """A metric is an aggregate over (truth, prediction) columns, or, where
    one aggregate cannot express it, a function of the grouped table."""

    name: str
    greater_is_better: bool
    needs_proba: bool
    aggregate: Callable[[Column, Column], Column] | None = None
    table: Callable[[DataFrame, str, str, str], DataFrame] | None = None


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmsle(y: Column, p: Column) -> Column:
    gap = F.log1p(y) - F.log1p(F.when(p < 0, F.lit(0.0)).otherwise(p))
    return F.sqrt(F.avg(gap * gap))


def r2(y: Column, p: Column) -> Column:
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    flat = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(spread > 0, 1 - F.try_divide(residual, spread)).otherwise(flat)


def logloss(y: Column, p: Column) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(LOGLOSS_CLIP)), F.lit(1 - LOGLOSS_CLIP)))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def mlogloss(label: Column, probs: Column) -> Column:
    q = F.element_at(probs, label.cast("int") + 1)
    return -F.avg(F.when(q.isNotNull(), F.ln(F.least(F.greatest(q, F.lit(EPSILON)), F.lit(1.0)))))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def f1(y: Column, p: Column) -> Column:
    hit = F.count_if((y == 1) & (p == 1))
    wrong = F.count_if((y == 1) != (p == 1))
    return F.coalesce(F.try_divide(2.0 * hit, 2.0 * hit + wrong), F.lit(0.0))


def f1_macro(df: DataFrame, fold: str, y: str, p: str) -> DataFrame:
    """Unweighted mean of the F1 of every class seen or predicted."""
    sides = F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("real")),
                    F.struct(F.col(p).alias("c"), F.lit(0).alias("real")))
    per_class = (df.select(fold, (F.col(y) == F.col(p)).cast("int").alias("_hit"),
                           F.explode(sides).alias("s"))
                 .groupBy(fold, F.col("s.c").alias("_c"))
                 .agg(F.sum(F.col("_hit") * F.col("s.real")).alias("tp"),
                      F.count(F.lit(1)).alias("n")))
    return per_class.groupBy(fold).agg(F.avg(2.0 * F.col("tp") / F.col("n")).alias("score"))


def auc(df: DataFrame, fold: str, y: str, p: str,
        pairs_per_piece: int = PAIRS_PER_PIECE) -> DataFrame:
    """Exact area under the ROC curve per fold, ties counted half.

    Equal scores are combined first, and only those pairs of counts are kept.
    They are then cut into ranges so that each running count covers one range;
    the few range totals give the rest: every positive also beats all
    negatives of the lower ranges.
    """
    pairs = materialize(
        df.select(F.col(fold), F.col(y).cast("double").alias("_y"),
                  F.col(p).cast("double").alias("_p"))
        .groupBy(fold, "_p").agg(F.count_if(F.col("_y") == 1).alias("pos"),
                                 F.count_if(F.col("_y") == 0).alias("neg")))
    n = pairs.count()
    pieces = min(-(-n // pairs_per_piece), MAX_PIECES)
    cuts = rough_cuts(pairs, F.col("_p"), pieces, n) if pieces > 1 else []
    scored = with_bins(pairs, {"_piece": (F.col("_p"), cuts)})
    below = (W.partitionBy(fold, "_piece").orderBy("_p")
             .rowsBetween(W.unboundedPreceding, -1))
    ranges = (scored.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
              .groupBy(fold, "_piece")
              .agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)).alias("inner"),
                   F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    earlier = W.partitionBy(fold).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    total = (ranges.withColumn("before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
             .groupBy(fold)
             .agg(F.sum(F.col("inner") + F.col("pos") * F.col("before")).alias("wins"),
                  F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    return total.select(fold, F.try_divide(
        F.col("wins"), F.col("pos").cast("double") * F.col("neg")).alias("score"))


METRICS = {m.name: m for m in [
    Metric("rmse", False, False, rmse),
    Metric("mae", False, False, mae),
    Metric("rmsle", False, False, rmsle),
    Metric("r2", True, False, r2),
    Metric("auc", True, True, table=auc),
    Metric("logloss", False, True, logloss),
    Metric("accuracy", True, False, accuracy),
    Metric("f1", True, False, f1),
    Metric("f1_macro", True, False, table=f1_macro),
    Metric("mlogloss", False, True, mlogloss),
]}


def register_metric(metric: Metric) -> None:
    """Add a user's own metric to the registry."""
    if (metric.aggregate is None) == (metric.table is None):
        raise ValueError("a metric needs either an aggregate or a table function")
    METRICS[metric.name] = metric


def select_metric(text: str, problem_type: str) -> Metric:
    """Metric named first in the list of patterns that the text matches."""
    name = next((m for pattern, m in METRIC_PATTERNS
                 if re.search(pattern, text.lower())), DEFAULT_METRIC[problem_type])
    if name == "logloss" and problem_type == "multiclass":
        name = "mlogloss"
    return METRICS[name]


def metric_name(text: Column, problem_type: Column) -> Column:
    """The same choice for a table of task texts."""
    lowered = F.lower(text)
    default = F.element_at(F.create_map(*[F.lit(x) for p in DEFAULT_METRIC.items() for x in p]),
                           problem_type)
    named = F.coalesce(*[F.when(lowered.rlike(pattern), F.lit(name))
                         for pattern, name in METRIC_PATTERNS], default)
    return F.when((named == "logloss") & (problem_type == "multiclass"),
                  F.lit("mlogloss")).otherwise(named)


def score_table(df: DataFrame, metric: Metric, fold: str, y: str, p: str) -> DataFrame:
    """``(fold, score)`` of one metric, a row for every fold.

    A fold in which a labelled row has no prediction, or for which the metric
    is not defined, has a null score: it must not look better than it is.
    """
    missing = F.count_if(F.col(y).isNotNull() & F.col(p).isNull())
    if metric.table is None:
        return df.groupBy(fold).agg(
            F.when(missing == 0, metric.aggregate(F.col(y), F.col(p))).alias("score"))
    folds = df.groupBy(fold).agg(missing.alias("_missing"))
    return (folds.join(metric.table(df, fold, y, p), fold, "left")
            .select(fold, F.when(F.col("_missing") == 0, F.col("score")).alias("score")))


def score_folds(df: DataFrame, metric: Metric, fold: str, label: str, pred: str,
                n_classes: int) -> DataFrame:
    """Score raw model output: class positions are decoded where the metric
    compares labels, probabilities are used as they are otherwise."""
    if metric.needs_proba or n_classes < 2:
        return score_table(df, metric, fold, label, pred)
    positions = [float(i) for i in range(n_classes)]
    decode = decode_binary if n_classes == 2 else decode_probabilities
    decoded = df.withColumn("_decoded", decode(F.col(pred), positions))
    return score_table(decoded, metric, fold, label, "_decoded")
