import pytest
from pyspark.sql import functions as F

from foldmark.constants import DEFAULT_METRIC
from foldmark.functions.kinds import categorical_columns, kinds
from foldmark.operators import framing as fr
from foldmark.operators.metrics import METRICS, Metric, register_metric, select_metric


def frame(spark, columns, rows=((1,),)):
    return spark.createDataFrame([tuple(range(len(columns)))], columns)


@pytest.mark.parametrize("train,test,text,want", [
    (["id", "a", "z"], ["id", "a"], "", "z"),                       # only one missing in test
    (["id", "Label", "y", "q"], ["id"], "", "Label"),               # names in their order
    (["id", "a", "b", "c"], ["id"], "the target column: `b`", "b"),  # named in the text
    (["id", "a", "b", "c"], ["id"], "target: nothing", "c"),        # last of the missing
    (["id", "a"], ["id", "a"], "", "a"),                            # last column
])
def test_guess_target(spark, train, test, text, want):
    assert fr.guess_target(frame(spark, train), frame(spark, test), text) == want


def test_guess_id(spark):
    train = spark.createDataFrame([(1, 5, 1.0, 7), (2, 5, 2.0, 7)], "width int, id int, row double, key int")
    test = spark.createDataFrame([(3, 6, 1.0, 1), (4, 7, 2.0, 2)], "width int, id int, row double, key int")
    assert fr.guess_id(train, test) == "width"          # holds "id" and is unique
    assert fr.guess_id(train.drop("width"), test.drop("width")) is None
    named = train.select(F.col("width").alias("key"))
    assert fr.guess_id(named, test.select("key")) == "key"
    assert fr.guess_id(train.select("row"), test.select("row")) is None    # not an integer


@pytest.mark.parametrize("values,dtype,want", [
    ([0, 1, None, 1], "int", ("binary", 2, [0, 1])),
    (["b", "a"], "string", ("binary", 2, ["a", "b"])),
    ([1.0, 2.0, 3.0], "double", ("multiclass", 3, [1.0, 2.0, 3.0])),
    ([1.0, 2.5], "double", ("regression", 1, None)),
    (list(range(21)), "int", ("regression", 1, None)),
    (list(range(20)), "int", ("multiclass", 20, list(range(20)))),
    ([f"c{i:02}" for i in range(60)], "string", ("multiclass", 60, [f"c{i:02}" for i in range(60)])),
    (list(range(51)) * 25, "int", ("regression", 1, None)),
    (list(range(50)) * 25, "int", ("multiclass", 50, list(range(50)))),
])
def test_problem_type(spark, values, dtype, want):
    df = spark.createDataFrame([(v,) for v in values], f"t {dtype}")
    assert fr.problem_type(df, "t") == want


def test_constant_target(spark):
    with pytest.raises(ValueError, match="constant"):
        fr.problem_type(spark.createDataFrame([(3,), (3,)], "t int"), "t")


def test_build_spec(spark):
    train = spark.createDataFrame([(i, float(i), 0.5 * i) for i in range(20)], "id int, x double, y double")
    test = train.drop("y")
    spec = fr.build_spec(["Predict.", "RMSE"], ["data"], train, test)
    assert (spec.target, spec.id, spec.problem_type, spec.n_classes) == ("y", "id", "regression", 1)
    assert spec.task_text == "Predict.\n\nRMSE"
    row = spec.summary().first()
    assert (row["n_train"], row["n_test"], row["n_features"]) == (20, 20, 1)
    with pytest.raises(ValueError, match="no target"):
        fr.build_spec([""], [""], train, test, target="nope")


def test_guards(spark):
    good = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    fr.check_features(good, good, "y", "id")
    for bad, match in [(good.withColumn("y", F.lit(1)), "target"),
                       (good.withColumn("id", F.lit(1)), "id column")]:
        with pytest.raises(ValueError, match=match):
            fr.check_features(bad, bad, "y", "id")
    with pytest.raises(ValueError, match=r"only in train \['b'\]"):
        fr.check_features(good, good.drop("b"), "y", "id")
    with pytest.raises(ValueError, match="no feature"):
        fr.check_features(good.select(), good.select(), "y", "id")
    with pytest.raises(ValueError, match=r"\['b'\]"):
        empty = good.withColumn("b", F.lit(None).cast("double"))
        fr.check_features(empty, empty, "y", "id")


def test_kinds(spark):
    df = spark.sql("select true as b, timestamp'2020-01-01' as t, date'2020-01-01' as d, 1 as i, "
                   "1.5D as f, 1.5 as m, 'x' as s")
    assert kinds(df) == {"b": "bool", "t": "datetime", "d": "datetime", "i": "integer",
                         "f": "float", "m": "float", "s": "categorical"}
    assert categorical_columns(df) == ["b", "s"]
    with pytest.raises(TypeError):
        kinds(spark.sql("select array(1) as a"))


@pytest.mark.parametrize("text,kind,want", [
    ("scored by RMSLE", "regression", "rmsle"), ("Root Mean Squared Error", "regression", "rmse"),
    ("area under the ROC curve", "binary", "auc"), ("Log Loss", "multiclass", "mlogloss"),
    ("log-loss", "binary", "logloss"), ("f1_macro", "multiclass", "f1_macro"),
    ("F1", "binary", "f1"), ("accuracy", "binary", "accuracy"), ("R2", "regression", "r2"),
    ("", "binary", "auc"), ("", "multiclass", "mlogloss"), ("", "regression", "rmse"),
])
def test_metric_choice(text, kind, want):
    assert select_metric(text, kind).name == want
    assert set(DEFAULT_METRIC) == {"binary", "multiclass", "regression"}


def test_register_metric():
    with pytest.raises(ValueError):
        register_metric(Metric("none", True, False))
    assert "none" not in METRICS
