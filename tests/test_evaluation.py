"""Recipes, leaks, cross-validation and submissions."""

import pytest
from pyspark.sql import functions as F

from foldmark.operators.evaluate import once_per_id
from foldmark.operators.framing import ProblemSpec, build_spec
from foldmark.operators.metrics import METRICS
from foldmark.operators.model import ModelParams
from foldmark.operators.slots import Slots
from foldmark.operators.submission import running_number, submission
from foldmark.plans.contract import FOLD, KEY, LABEL, OWN_FOLD, Solution, feature_names
from foldmark.plans.evaluation import cross_validate, cv_features, solve, with_folds
from foldmark.plans.fixtures import order_spec
from foldmark.plans.recipes import Curriculum, PassThrough, RecordedFeatures

QUICK = ModelParams(rounds=3, depth=3)


@pytest.fixture(scope="module")
def table(spark):
    """A binary target with text, numeric and sequence columns."""
    return spark.range(600).select(
        F.col("id"), (F.col("id") % 7).cast("string").alias("driver"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("r"), F.col("id") % 5)).alias("race"),
        F.exp(F.col("id") % 13 / 2.0).alias("wide"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 37 % 101).cast("double")).alias("num"),
        (F.col("id") * 17 % 23 < 4).cast("int").alias("pit"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("y"))


def spec_of(table, target="y", **change):
    train = table.withColumns(change) if change else table
    return build_spec([""], [""], train, train.drop(target), target)


@pytest.mark.parametrize("recipe", [
    Curriculum(4),
    RecordedFeatures(count_columns=["driver"], target_columns=["driver", "race", "absent"],
                     zero_columns=["num"], log_columns=["wide"], cyclic_columns=["num"],
                     crosses=[("driver", "num")], history=(["driver", "race"], "id", "pit"),
                     history_cross="num")])
def test_target_of_a_fold_never_reaches_its_features(table, recipe):
    """Change every target inside fold 2: features of fold 2 stay the same,
    those of other folds change somewhere."""
    folds = with_folds(spec_of(table), 5)

    def features(rows):
        recipe.fit(rows, spec, Slots(FOLD, 5))
        out = recipe.transform(rows, OWN_FOLD)
        names = sorted(feature_names(out))
        return {r[KEY]: (r[FOLD], [r[c] for c in names]) for r in out.collect()}

    spec = spec_of(table)
    before = features(folds)
    after = features(folds.withColumn(LABEL, F.when(F.col(FOLD) == 2, 1 - F.col(LABEL))
                                      .otherwise(F.col(LABEL))))
    assert len(before) == 600
    assert all(before[k] == after[k] for k in before if before[k][0] == 2)
    assert any(before[k] != after[k] for k in before if before[k][0] != 2)


def test_holdout_equals_own_fold(table):
    """Features of fold k by its own fold are those with fold k held out."""
    rows = with_folds(spec_of(table), 3)
    recipe = Curriculum(3)
    recipe.fit(rows, spec_of(table), Slots(FOLD, 3))
    own = recipe.transform(rows, OWN_FOLD)
    for k in range(3):
        held = recipe.transform(rows, k)
        names = sorted(set(held.columns) & set(own.columns))
        a = own.filter(F.col(FOLD) == k).select(names).collect()
        b = held.filter(F.col(FOLD) == k).select(names).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_curriculum_steps_add_columns(table):
    rows = with_folds(spec_of(table), 3)
    columns = []
    for step in range(6):
        recipe = Curriculum(step)
        recipe.fit(rows, spec_of(table), Slots())
        columns.append(set(feature_names(recipe.transform(rows))))
    assert all(a <= b for a, b in zip(columns, columns[1:]))
    assert columns[0] == {"wide", "wide__isna", "wide__log1p", "num", "num__isna", "pit",
                          "pit__isna", "driver", "race"}
    assert {"driver__freq", "race__freq"} == columns[1] - columns[0]
    assert {"driver__te", "race__te"} == columns[2] - columns[1]
    assert {"wide_x_num", "wide_div_num", "__row_mean", "__row_std"} <= columns[3]
    assert columns[4] == columns[5] == columns[3]


def test_recorded_columns_in_order(table):
    recipe = RecordedFeatures(count_columns=["driver"], target_columns=["race"],
                              zero_columns=["num"], log_columns=["wide"])
    rows = with_folds(spec_of(table), 3)
    recipe.fit(rows, spec_of(table), Slots())
    assert feature_names(recipe.transform(rows)) == [
        "driver", "race", "wide", "num", "pit", "driver_freq", "num_is_zero", "log_wide", "race_te"]


def test_binary_cross_validation(table):
    result = cross_validate(Curriculum(2), spec_of(table), METRICS["auc"], 3, params=QUICK)
    assert result.ok, result.error
    row = result.summary.first()
    assert len(row["fold_scores"]) == 3
    assert row["score"] == pytest.approx(sum(row["fold_scores"]) / 3)
    assert once_per_id(result.oof, KEY).count() == 0 and result.oof.count() == 600
    assert result.n_features == len({r["feature"] for r in result.importance.collect()})


@pytest.mark.parametrize("target,metric", [("num2", "rmse"), ("kind", "f1_macro")])
def test_other_targets(table, target, metric):
    changed = table.drop("y").withColumns(
        {"num2": F.col("id") * 0.37 + 0.5} if target == "num2"
        else {"kind": F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int"))})
    spec = spec_of(changed, target)
    assert spec.problem_type == ("regression" if target == "num2" else "multiclass")
    result = cross_validate(Curriculum(4), spec, METRICS[metric], 3, params=QUICK)
    assert result.ok, result.error
    assert result.summary.first()["score"] is not None
    sub = solve(Curriculum(4), spec, QUICK)
    assert sub.columns == ["id", target] and sub.count() == 600
    if target == "kind":
        assert {r[0] for r in sub.select(target).distinct().collect()} <= {"x", "y", "z"}


class _Broken(PassThrough):
    def transform(self, df, holdout=None):
        return super().transform(df, holdout).withColumn("y", F.lit(1))


def test_faulty_solution_is_a_failed_result(table):
    result = cross_validate(_Broken(), spec_of(table), METRICS["auc"], 3, params=QUICK)
    assert not result.ok and "target 'y'" in result.error
    with pytest.raises(TypeError):
        Solution()


class _ReadsLabel(PassThrough):
    def transform(self, df, holdout=None):
        return df.select(KEY, FOLD, F.col(LABEL).alias("best"))


class _LearnsAll(Solution):
    """Remembers the target of every row it is fitted on."""

    def fit(self, train, spec, slots):
        self.seen = train.select(F.col(KEY).alias("k"), F.col(LABEL).alias("best"))

    def transform(self, df, holdout=None):
        return df.join(self.seen, F.col(KEY) == F.col("k"), "left").select(
            *[c for c in (KEY, FOLD) if c in df.columns], F.coalesce("best", F.lit(0.5)).alias("best"))


def test_label_cannot_leak(table):
    read = cross_validate(_ReadsLabel(), spec_of(table), METRICS["auc"], 3, params=QUICK)
    assert not read.ok and LABEL in read.error
    learnt = cross_validate(_LearnsAll(), spec_of(table), METRICS["auc"], 3, params=QUICK)
    assert learnt.ok and abs(learnt.summary.first()["score"] - 0.5) < 0.01
    out = cv_features(_LearnsAll(), spec_of(table), 3)
    assert out.filter("best <> 0.5").count() == 0 and out.count() == 600


def test_cv_features_hide_the_target(table):
    out = cv_features(PassThrough(), spec_of(table), 3)
    assert feature_names(out) == ["driver", "race", "wide", "num", "pit"]


def test_running_number(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    got = sorted(r["n"] for r in running_number(df, "n").collect())
    assert got == list(range(334))
    assert running_number(df.filter("id < 0"), "n").count() == 0


def test_submission_keeps_probabilities(spark):
    pred = spark.createDataFrame([(7, 0.25)], "id int, pred double")
    spec = ProblemSpec("", "", "t", "id", "binary", 2, [0, 1], pred, pred)
    assert [tuple(r) for r in submission(pred, spec).collect()] == [(7, 0.25)]


def test_refit_without_id(spark, folder):
    spec = order_spec(spark, folder)
    bare = ProblemSpec("", "", "y", None, "binary", 2, [0, 1],
                       spec.train.drop("order_id"), spec.test.drop("order_id"))
    out = solve(PassThrough(), bare, QUICK)
    n = bare.test.count()
    assert sorted(r["id"] for r in out.collect()) == list(range(n))
