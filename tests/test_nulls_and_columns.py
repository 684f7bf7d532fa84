"""Null rules and scalar columns on hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from foldmark.functions import features as fx
from foldmark.functions.moments import adjusted_kurtosis, adjusted_skew
from foldmark.operators import eda
from foldmark.operators.encode import fit_levels, level_counts
from foldmark.operators.evaluate import improves, score_summary
from foldmark.operators.framing import problem_type
from foldmark.operators.metrics import METRICS, score_folds, score_table
from foldmark.sources.tables import nan_to_null, seeded_sample


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", None, 0.0), (None, 4.0, 3.0), ("b", 0.0, None), (None, None, 1.0)],
        "c string, x double, z double")


def test_distinct_and_missing_leave_nulls_out(holes):
    assert {r["column"]: r["n_unique"] for r in eda.distinct_counts(holes).collect()} == \
        {"c": 2, "x": 3, "z": 4}
    assert {r["column"]: r["missing_frac"] for r in eda.missing(holes).collect()} == \
        {"c": 0.4, "x": 0.4, "z": 0.2}


def test_null_is_a_level_or_is_not(holes):
    with_null = level_counts(holes, {"c": F.col("c")}).collect()
    assert {r["level"]: r["n"] for r in with_null} == {"a": 2, "b": 1, "__nan__": 2}
    without = level_counts(holes, {"c": F.col("c")}, null_level=False).collect()
    assert {r["level"]: r["n"] for r in without} == {"a": 2, "b": 1}


def test_null_row_falls_back(holes):
    """Nulls outside the levels: count 0 and the mean of all rows."""
    rows = holes.withColumn("k", F.monotonically_increasing_id())
    encoder = fit_levels(rows, ["c"], F.col("z"), smoothing=10.0, null_level=False)
    got = [(r["c_n"], r["c_te"]) for r in encoder.transform(rows, "k", count="_n", target="_te")
           .filter("c is null").collect()]
    assert got == [(0, 1.5), (0, 1.5)]
    assert encoder.rows == [5]


def test_unseen_level(holes):
    rows = holes.withColumn("k", F.monotonically_increasing_id())
    encoder = fit_levels(rows.filter("c = 'a'"), ["c"], F.col("z"))
    got = encoder.transform(rows, "k", frequency="_f", target="_te").filter("c = 'b'").first()
    assert (got["c_f"], got["c_te"]) == (0.0, 1.0)


def test_scalar_columns(spark):
    row = spark.range(1).select(
        fx.ratio(F.lit(3), F.lit(0)).alias("ratio"), fx.inf_to_null(F.lit(float("-inf"))).alias("inf"),
        fx.inf_to_null(F.lit(float("nan"))).alias("nan"), fx.log1p_floor(F.lit(-4.0)).alias("log"),
        fx.zero_flag(F.lit(None).cast("int")).alias("zero"), fx.is_missing(F.lit(None)).alias("na"),
        fx.row_mean([F.lit(1), F.lit(None).cast("int"), F.lit(4)]).alias("mean"),
        fx.row_std([F.lit(1), F.lit(None).cast("int")]).alias("one"),
        fx.row_std([F.lit(1.0), F.lit(4.0), F.lit(None).cast("double")]).alias("std"),
        fx.clip_to_range(F.lit(99.0), 0.0, 10.0).alias("clip"),
        fx.null_token(F.lit(None)).alias("token"), fx.cyclic(F.lit(0.25))[0].alias("sin"),
        fx.row_mean([F.lit(None).cast("double")]).alias("none")).first()
    assert row["ratio"] is None and row["inf"] is None and row["nan"] is None
    assert (row["log"], row["zero"], row["na"]) == (0.0, 0, 1)
    assert (row["mean"], row["one"], row["none"]) == (2.5, None, None)
    assert row["std"] == pytest.approx(math.sqrt(4.5))
    assert row["clip"] == pytest.approx(10.2)
    assert row["token"] == "__nan__" and row["sin"] == pytest.approx(1.0)


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, i int"))
    assert [tuple(r) for r in df.collect()] == [(None, 1), (2.0, None)]


@pytest.mark.parametrize("values,skew,kurtosis", [
    ([1.0, 1.0, 1.0], 0.0, None), ([1.0, 2.0], 0.0, None), ([], None, None), ([None], None, None)])
def test_moments_of_few_values(spark, values, skew, kurtosis):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(adjusted_skew(F.col("x")).alias("s"), adjusted_kurtosis(F.col("x")).alias("k")).first()
    assert (row["s"], row["k"]) == (skew, kurtosis)


def test_moments_match_pandas(spark):
    import pandas as pd
    values = pd.Series([1.0, 2.0, 2.5, 9.0, 0.1, 4.0])
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(adjusted_skew(F.col("x")).alias("s"), adjusted_kurtosis(F.col("x")).alias("k")).first()
    assert row["s"] == pytest.approx(values.skew())
    assert row["k"] == pytest.approx(values.kurt())


def test_long_texts_are_told_apart(spark):
    long = "x" * 200
    rows = spark.createDataFrame([(t,) for t in (long, long, long + "y", "x" * 64, "x", None, None)],
                                 "t string")
    assert eda.distinct_counts(rows).first()["n_unique"] == 4
    assert eda.duplicate_rows(rows).first()["n_duplicates"] == 2
    assert eda.high_cardinality(rows).first()["high_cardinality"]


def test_target_profile_shows_null(holes):
    got = {r["stat"]: r["value"] for r in eda.target_profile(holes, "c").collect()}
    assert got == {"a": 2.0, "null": 2.0, "b": 1.0}


def test_leak_by_dependency_counts_null_targets(spark):
    df = spark.createDataFrame([(i, i % 2 if i else None) for i in range(8)], "k int, y int")
    assert [r["column"] for r in eda.leak_by_dependency(df, "y").collect()] == ["k"]


def test_exact_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 0.0), (1, 1.0, 0.0), (1, 0.0, 1.0)],
                               "fold int, y double, p double")
    def score(name):
        return {r["fold"]: r["score"] for r in score_table(df, METRICS[name], "fold", "y", "p").collect()}
    assert score("rmse") == {0: 0.0, 1: 1.0}
    assert score("r2") == {0: 1.0, 1: -3.0}
    assert score("accuracy") == {0: 1.0, 1: 0.0}
    assert score("f1") == {0: 1.0, 1: 0.0}
    assert score("f1_macro") == {0: 1.0, 1: 0.0}
    assert score("logloss")[0] == pytest.approx(1e-7, rel=1e-3)
    assert score("logloss")[1] == pytest.approx(-math.log(1e-7), rel=1e-6)
    flat = spark.createDataFrame([(0, 2.0, 2.0), (1, 2.0, 3.0)], "fold int, y double, p double")
    assert {r["score"] for r in score_table(flat, METRICS["r2"], "fold", "y", "p").collect()} == {0.0, 1.0}


def test_labels_are_decoded_for_label_metrics(spark):
    df = spark.createDataFrame([(0, 2.0, [.1, .2, .7]), (0, 0.0, [.4, .4, .2])],
                               "fold int, y double, p array<double>")
    assert score_folds(df, METRICS["accuracy"], "fold", "y", "p", 3).first()["score"] == 1.0


def test_accept_rule(spark):
    def better(score, ok, best, std, best_ok, up):
        row = spark.range(1).select(improves(
            F.lit(score), F.lit(ok), F.lit(best).cast("double"), F.lit(std).cast("double"),
            F.lit(best_ok), up).alias("b"))
        return row.first()["b"]

    assert not better(0.9, False, None, None, None, True)
    assert better(0.1, True, None, None, None, True)
    assert better(0.1, True, 0.5, 0.1, False, True)
    assert not better(0.51, True, 0.5, 0.1, True, True)     # on the margin
    assert better(0.5101, True, 0.5, 0.1, True, True)
    assert better(0.4899, True, 0.5, 0.1, True, False)
    assert better(0.5 + 1e-9, True, 0.5, 0.0, True, True)   # floor of the noise


def test_sample_is_exact(spark):
    df = spark.range(5000)
    got = [r["id"] for r in seeded_sample(df, "id", 100, 1000).collect()]
    from hashlib import md5
    want = sorted(range(5000), key=lambda i: (md5(f"42|{i}".encode()).hexdigest(), i))[:100]
    assert got == want
    assert seeded_sample(df, "id", 100, 5000).count() == 5000


def test_missing_predictions_and_one_class_folds_have_no_score(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, None), (1, 1.0, 1.0), (1, 0.0, 0.0)],
                               "fold int, y double, p double")
    for name in ("rmse", "r2", "accuracy", "f1", "f1_macro", "auc"):
        got = {r["fold"]: r["score"] for r in score_table(df, METRICS[name], "fold", "y", "p").collect()}
        assert got[0] is None and got[1] is not None, name
    one = spark.createDataFrame([(0, 1.0, 0.3), (1, 1.0, 0.9), (1, 0.0, 0.1)], "fold int, y double, p double")
    scores = score_table(one, METRICS["auc"], "fold", "y", "p")
    assert {r["fold"]: r["score"] for r in scores.collect()} == {0: None, 1: 1.0}
    assert score_summary(scores).first()["score"] is None


def test_decimal_targets_are_judged_as_numbers(spark):
    df = spark.range(50).select((F.col("id") % 5 + 0.25).cast("decimal(12,2)").alias("y"))
    assert problem_type(df, "y")[0] == problem_type(df.select(F.col("y").cast("double")), "y")[0] == "regression"


def test_read_tables_have_no_nan_and_one_zero(spark, tmp_path):
    from foldmark.operators import eda
    from foldmark.sources.tables import read_table
    rows = spark.createDataFrame([(float("nan"), 1), (-0.0, 2), (0.0, 3), (2.5, 4), (None, 5)], "x double, id int")
    rows.write.parquet(f"{tmp_path}/t.parquet")
    table = read_table(spark, str(tmp_path), "t")
    stats = eda.numeric_stats(table, ["x"]).first()
    assert (stats["min"], stats["max"], stats["zeros_frac"]) == (0.0, 2.5, 0.6667)
    assert eda.missing(table, ["x"]).first()["missing_frac"] == 0.4
    assert eda.distinct_counts(table, ["x"]).first()["n_unique"] == 2


def test_long_texts_on_top_come_back_whole(spark):
    from foldmark.operators.eda import top_values
    long = "word " * 500
    rows = spark.createDataFrame([(long,)] * 3 + [("a",)] * 2 + [(long + "b",), (None,)], "t string")
    got = [(r["value"], r["n"], r["place"]) for r in top_values(rows, ["t"], 3).orderBy("place").collect()]
    assert got == [(long, 3, 1), ("a", 2, 2), (long + "b", 1, 3)]


def test_dates_are_related_to_the_target(spark):
    from foldmark.operators.information import target_relation
    rows = spark.range(400).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
                                   F.when(F.col("id") < 200, "a").otherwise("b").alias("y"))
    best = target_relation(rows, "y").first()
    assert best["column"] == "day" and best["mutual_info"] > 0.6
