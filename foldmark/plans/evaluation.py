"""Cross-validation, refit and submission."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foldmark.constants import CV_FOLDS, HOLDOUT_SHARE, SEED
from foldmark.functions.hashing import hash_unit
from foldmark.functions.labels import label_index
from foldmark.operators import folds as fold_ops
from foldmark.operators.slots import Slots
from foldmark.operators.evaluate import importance_mean, score_summary
from foldmark.operators.framing import ProblemSpec, check_schemas
from foldmark.operators.metrics import METRICS, Metric, score_folds
from foldmark.operators.model import ModelParams, fit_model, fit_models
from foldmark.operators.submission import submission
from foldmark.plans.contract import (
    FOLD, KEY, LABEL, NONE, OWN_FOLD, Solution, feature_names, features_only, keeps_slots,
)
from foldmark.session import discard, materialize, stored


@dataclass(frozen=True)
class EvalResult:
    """Scores, out-of-fold predictions and importance of one solution."""

    ok: bool
    summary: DataFrame | None = None        # score, score_std, fold_scores
    oof: DataFrame | None = None            # key, fold, label, pred
    importance: DataFrame | None = None     # feature, importance
    n_features: int = 0
    error: str = ""


def with_label(df: DataFrame, spec: ProblemSpec) -> DataFrame:
    y = F.col(spec.target)
    label = y.cast("double") if spec.problem_type == "regression" \
        else label_index(y, spec.labels)
    return df.withColumn(LABEL, label)


@dataclass(frozen=True)
class Splits:
    """How rows are split: by key, with ``groups`` kept together, or in
    expanding windows of ``time``, where a fold is trained on what came before."""

    groups: str | None = None
    time: str | None = None


def with_folds(spec: ProblemSpec, folds: int = CV_FOLDS, seed: int = SEED,
               key: str | None = None, splits: Splits = Splits()) -> DataFrame:
    """The training table with key, label and fold; the target itself gone.

    By key, classes are spread evenly over folds and regression rows go by
    their hash.
    """
    key = key or spec.id
    if key is None:
        raise ValueError("a key column is needed to assign folds")
    rows = with_label(spec.train, spec).withColumn(KEY, F.col(key)).drop(spec.target)
    guard_key(rows)
    if splits.time is not None:
        return fold_ops.time_blocks(rows, splits.time, folds, FOLD)
    if splits.groups is not None:
        return fold_ops.group_kfold(rows, splits.groups, KEY, folds, seed, FOLD)
    if spec.problem_type == "regression":
        return fold_ops.kfold(rows, KEY, folds, seed, FOLD)
    return fold_ops.stratified_kfold(rows, KEY, LABEL, folds, seed, FOLD)


def guard_key(rows: DataFrame) -> None:
    """Labels are joined back by the key, so every row needs one of its own."""
    bad = rows.groupBy(KEY).count().filter((F.col("count") > 1) | F.col(KEY).isNull())
    if bad.limit(1).count():
        raise ValueError("the key has nulls or repeats")


# A task of the join of features and labels sorts about so many rows.
ROWS_PER_JOIN = 250_000


def join_pieces(rows: DataFrame) -> int:
    """Tasks that a join of these rows by key is dealt to."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_JOIN))


def labelled_features(solution: Solution, rows: DataFrame, holdout: int | None, pieces: int) -> DataFrame:
    """Features of rows, made without their label, which is joined by key.

    The number of pieces is given, as Spark would else put a fold's rows into
    one task where the joins of several folds are written together.
    """
    made = solution.transform(rows.drop(LABEL), holdout).drop(LABEL)
    return made.repartition(pieces, KEY).join(rows.select(KEY, LABEL).repartition(pieces, KEY), KEY)


def fold_views(solution: Solution, rows: DataFrame, spec: ProblemSpec, folds: int,
               splits: Splits = Splits()):
    """Per fold, the condition of its training rows and the holdout to transform
    with; the solution is fitted on those rows, or on all with a slot per fold."""
    aware = keeps_slots(solution) and splits.time is None
    if aware:
        solution.fit(rows, spec, Slots(FOLD, folds))
    for k in range(1, folds + 1) if splits.time is not None else range(folds):
        part = F.col(FOLD) < k if splits.time is not None else F.col(FOLD) != k
        if not aware:
            solution.fit(rows.filter(part), spec, Slots())
        yield k, part, (k if aware else NONE)


def cv_features(solution: Solution, spec: ProblemSpec, folds: int = CV_FOLDS,
                seed: int = SEED, key: str | None = None) -> DataFrame:
    """Leak-safe features of every row, each from the other folds."""
    rows = materialize(with_folds(spec, folds, seed, key))
    pieces = join_pieces(rows)
    if keeps_slots(solution):
        solution.fit(rows, spec, Slots(FOLD, folds))
        return labelled_features(solution, rows, OWN_FOLD, pieces)
    return reduce(DataFrame.unionByName, [
        materialize(labelled_features(solution, rows.filter(F.col(FOLD) == k), holdout, pieces))
        for k, _, holdout in fold_views(solution, rows, spec, folds)])


def guard_values(parts: DataFrame, names: list[str]) -> None:
    """No part may have a feature without any value: one pass for all parts."""
    found = parts.groupBy("_part").agg(
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)]).collect()
    bad = sorted({c for r in found for i, c in enumerate(names) if r[f"_{i}"] == 0})
    if bad:
        raise ValueError(f"feature columns without any value: {bad}")


def cross_validate(solution: Solution, spec: ProblemSpec, metric: Metric,
                   folds: int = CV_FOLDS, seed: int = SEED,
                   params: ModelParams = ModelParams(),
                   key: str | None = None, splits: Splits = Splits()) -> EvalResult:
    """One model per fold, all boosted in step.

    The model of fold k is trained on the other rows, with statistics that
    leave fold k out, and predicts fold k with the same statistics.  Training
    and held-out rows are transformed apart, so the guards compare two frames.
    The features of all folds' training rows are written once.  Where rounds
    may end early, a tenth of a fold's training rows decides; the held-out fold
    never does.  Errors come back as a failed result.
    """
    try:
        rows = materialize(with_folds(spec, folds, seed, key, splits))
        pieces = join_pieces(rows)
        parts, held, names = None, {}, []
        for k, part, holdout in fold_views(solution, rows, spec, folds, splits):
            train, out = (labelled_features(solution, rows.filter(side), holdout, pieces)
                          for side in (part, F.col(FOLD) == k))
            check_schemas(features_only(train), features_only(out), spec.target, spec.id)
            names = names or feature_names(train)
            if feature_names(train) != names:
                raise ValueError("features differ between folds")
            held[k] = out, solution.postprocess(F.col("pred"), holdout)
            train = train.withColumn("_part", F.lit(k))
            parts = train if parts is None else parts.unionByName(train)
        table, path = stored(parts, "fold-features")
        guard_values(table, names)
        stops = params.patience < params.rounds
        marked = holdout_split(table, KEY) if stops else table.withColumn("is_holdout", F.lit(False))
        sides = {k: (marked.filter((F.col("_part") == k) & ~F.col("is_holdout")),
                     marked.filter((F.col("_part") == k) & F.col("is_holdout")) if stops else None)
                 for k in held}
        models = fit_models(sides, names, LABEL, spec.problem_type, params, spec.n_classes, KEY)
        scored = [models[k].predict(out).withColumn("pred", post).select(KEY, FOLD, LABEL, "pred")
                  for k, (out, post) in held.items()]
        oof = materialize(reduce(DataFrame.unionByName, scored))
        discard(rows.sparkSession, path)
        scores = score_folds(oof, metric, FOLD, LABEL, "pred", spec.n_classes) \
            .withColumnRenamed(FOLD, "fold")
        summary = score_summary(scores)
        if summary.first()["score"] is None:
            raise ValueError("a fold has no score")
        importances = [m.importance(rows.sparkSession).withColumn("fold", F.lit(k))
                       for k, m in models.items()]
        return EvalResult(True, summary, oof,
                          importance_mean(reduce(DataFrame.unionByName, importances), None),
                          len(names))
    except Exception as error:      # a failing solution is a result, not a crash
        return EvalResult(False, error=f"{type(error).__name__}: {error}")


def _keyed(df: DataFrame, key: str | None) -> DataFrame:
    """Rows with the key; without one, a hash of the row that only spreads
    work and never decides a result."""
    return df.withColumn(KEY, F.col(key) if key else F.xxhash64(*df.columns))


def holdout_split(df: DataFrame, key: str, share: float = HOLDOUT_SHARE,
                  seed: int = SEED) -> DataFrame:
    """Mark the rows kept out of a fit to choose the number of rounds."""
    return df.withColumn("is_holdout", hash_unit(F.col(key), seed) >= share)


def refit_predict(solution: Solution, spec: ProblemSpec,
                  params: ModelParams = ModelParams(), early_stop: bool = True) -> DataFrame:
    """Fit on all training rows, predict the test table, postprocess.

    The statistics are learned from all training rows; one row in ten is then
    kept out of the trees to choose the number of rounds.
    """
    train = with_label(spec.train, spec).drop(spec.target)
    # the label is joined by key, so rows without an id get numbers of their own
    train = materialize(train.withColumn(
        KEY, F.col(spec.id) if spec.id else F.monotonically_increasing_id()))
    guard_key(train)
    test = _keyed(spec.test, spec.id)
    solution.fit(train, spec, Slots())
    table = materialize(holdout_split(labelled_features(solution, train, NONE, join_pieces(train)), KEY))
    names = [c for c in feature_names(table) if c != "is_holdout"]
    kept = table.filter(~F.col("is_holdout")) if early_stop else table
    model = fit_model(kept, names, LABEL, spec.problem_type, params,
                      table.filter("is_holdout") if early_stop else None, spec.n_classes, KEY)
    scored = model.predict(solution.transform(test, NONE))
    pred = solution.postprocess(F.col("pred"), NONE).alias("pred")
    if spec.id is None:
        return scored.select(pred)
    return scored.select(F.col(KEY).alias(spec.id), pred)


def solve(solution: Solution, spec: ProblemSpec, params: ModelParams = ModelParams()) -> DataFrame:
    """Train and test tables to a submission table."""
    return submission(refit_predict(solution, spec, params), spec)


def adversarial_validation(spec: ProblemSpec, solution: Solution, folds: int = CV_FOLDS,
                           seed: int = SEED, params: ModelParams = ModelParams()) -> EvalResult:
    """Can training and test rows be told apart by the solution's features?

    The AUC of a model that predicts which table a row is from: about 0.5 where
    both come from one source, near 1 where they differ.  Its importances name
    the features that differ.  Target and id are not shown to it.
    """
    shared = [c for c in spec.test.columns if c in spec.train.columns and c not in (spec.target, spec.id)]
    both = spec.train.select(*shared, F.lit(0).alias("_is_test")).unionAll(
        spec.test.select(*shared, F.lit(1).alias("_is_test")))
    # the rows' numbers have to be written before anything depends on them
    rows, path = stored(both.withColumn("_number", F.monotonically_increasing_id()), "adversarial")
    membership = ProblemSpec("", "", "_is_test", "_number", "binary", 2, [0, 1], rows,
                             rows.drop("_is_test").limit(0))
    result = cross_validate(solution, membership, METRICS["auc"], folds, seed, params)
    discard(rows.sparkSession, path)
    return result
