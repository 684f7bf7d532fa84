"""The ways taken on large or skewed data, forced on small fixtures and
compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators import lookup as lookup_module
from foldmark.operators import quantiles as q
from foldmark.operators.encode import fit_levels, fit_medians, fit_moments
from foldmark.operators.folds import stratified_kfold
from foldmark.operators.metrics import auc
from foldmark.operators.sequence import event_history, running_max_before
from foldmark.operators.slots import Slots


@pytest.fixture(scope="module")
def skewed(spark):
    """4000 rows, one entity with a third of them, tied order values."""
    rng = np.random.default_rng(5)
    n = 4000
    entity = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    at = np.where(rng.random(n) < 0.3, 777, rng.integers(0, 5000, n))
    flag = (rng.random(n) < 0.05).astype(int)
    x = np.where(rng.random(n) < 0.2, 1.5, rng.normal(size=n).round(3))
    pdf = __import__("pandas").DataFrame(
        {"id": np.arange(n), "entity": entity, "at": at, "flag": flag, "x": x,
         "fold": np.arange(n) % 5, "y": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf).repartition(6), pdf


@pytest.mark.parametrize("inside,accuracy,discrete", [
    (2_000_000, 10_000, False), (2_000_000, 10_000, True), (60, 100, False)])
def test_quantiles_match_numpy(skewed, monkeypatch, inside, accuracy, discrete):
    monkeypatch.setattr(q, "MAX_INSIDE", inside)
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    df, pdf = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = q.slot_quantiles(df, {"x": F.col("x"), "at": F.col("at")}, probs,
                           Slots("fold", 5), discrete)
    for c in ("x", "at"):
        for k in range(6):
            values = np.sort(pdf[c][pdf["fold"] != k].to_numpy(float))
            want = [values[max(int(np.ceil(round(len(values) * p, 9))) - 1, 0)] for p in probs] \
                if discrete else np.quantile(values, probs)
            np.testing.assert_allclose(got[c][k], want, atol=1e-12)


def test_quantiles_of_sorted_folds(spark, monkeypatch):
    """Folds with different ranges make the sketch interval wide, not wrong."""
    monkeypatch.setattr(q, "MAX_INSIDE", 10)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"),
                                  F.floor(F.col("id") / 200).cast("int").alias("fold"))
    got = fit_medians(df, ["x"], Slots("fold", 5))["x"]
    base = np.arange(1000.0)
    want = [np.median(base[base // 200 != k]) for k in range(5)] + [np.median(base)]
    np.testing.assert_allclose(got, want)


def test_quantiles_without_values(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("a"),
                               F.when(F.col("id") > 2, F.lit(float("nan")))
                               .otherwise(F.col("id")).alias("b"))
    got = q.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert got == {"a": [None], "b": [1.0]}
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    assert q.exact_quantiles(ends, {"x": F.col("x")}, [0.5]) == {"x": [1.0]}


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0.5, 1.0, 1.5, 2.0, 9.0)], "x double")
    out = q.with_bins(df, {"b": (F.col("x"), [1.0, 2.0])}).collect()
    assert [r["b"] for r in out] == [None, 0, 0, 1, 1, 2]


def _history(pdf):
    want = {}
    for _, g in pdf.sort_values(["at", "id"]).groupby("entity"):
        count, since = 0, -1
        for r in g.itertuples():
            count += r.flag
            since = 0 if r.flag else since + 1
            want[r.id] = (count, since)
    return want


@pytest.mark.parametrize("rows", [10_000, 300, 20])
def test_history_in_pieces(skewed, rows):
    df, pdf = skewed
    out = event_history(df, ["entity"], "at", "id", F.col("flag") == 1, rows_per_piece=rows)
    got = {r["id"]: (r["cum_count"], r["since_last"]) for r in out.collect()}
    assert got == _history(pdf)
    assert out.columns == [*df.columns, "cum_count", "since_last"]


def test_hot_order_value_is_split(skewed):
    from foldmark.operators.sequence import pieces
    df, _ = skewed
    sizes = [r["count"] for r in pieces(df, ["entity"], "at", "id", 100)
             .groupBy("entity", "_piece").count().collect()]
    assert max(sizes) < 150


@pytest.mark.parametrize("order", ["text", "local", "day"])
def test_order_columns_of_any_type_give_the_same_in_pieces(spark, order):
    rows = spark.range(600).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("entity"),
        F.concat(F.lit("t"), (F.col("id") * 7 % 90).cast("string")).alias("text"),
        F.expr("timestamp_ntz'2024-03-31 00:00:00'").alias("local"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"),
        (F.col("id") % 5 == 0).alias("flag"))
    rows = rows.withColumn("local", F.col("local") + F.make_dt_interval(mins=(F.col("id") * 13 % 400).cast("int")))
    want = event_history(rows, ["entity"], order, "id", F.col("flag"))
    got = event_history(rows, ["entity"], order, "id", F.col("flag"), rows_per_piece=40)
    columns = ["id", "cum_count", "since_last"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.mark.parametrize("rows", [10_000, 50])
def test_running_maximum_in_pieces(skewed, rows):
    df, pdf = skewed
    out = running_max_before(df, ["entity"], "at", "id", F.col("x"), "best", rows)
    got = {r["id"]: r["best"] for r in out.collect()}
    for _, g in pdf.sort_values(["at", "id"]).groupby("entity"):
        best = None
        for r in g.itertuples():
            assert got[r.id] == best
            best = r.x if best is None else max(best, r.x)


@pytest.mark.parametrize("pairs", [10_000, 100, 7])
def test_auc_in_pieces(skewed, pairs):
    df, pdf = skewed
    got = {r["fold"]: r["score"] for r in auc(df, "fold", "y", "x", pairs).collect()}
    for k, g in pdf.groupby("fold"):
        pos, neg = g.x[g.y == 1].to_numpy(), g.x[g.y == 0].to_numpy()
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert got[k] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_auc_extremes(spark):
    df = spark.createDataFrame([(0, 1, .9), (0, 0, .1), (1, 1, .1), (1, 0, .9), (2, 1, .5)],
                               "fold int, y int, p double")
    got = {r["fold"]: r["score"] for r in auc(df, "fold", "y", "p").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}


def test_lookup_by_salted_shuffle(skewed, monkeypatch):
    """Without broadcast, with hot levels spread, the result is the same."""
    df, _ = skewed
    encoder = fit_levels(df, ["entity", "at"], F.col("y"), Slots("fold", 5))

    def rows():
        out = encoder.transform(df, "id", -1, frequency="_f", target="_te")
        return sorted(map(tuple, out.select("id", "entity_f", "entity_te", "at_f", "at_te").collect()))

    small = rows()
    monkeypatch.setattr(lookup_module, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup_module, "HOT_SHARE", 0.01)
    assert not encoder.levels.broadcastable
    assert rows() == small
    assert len(small) == df.count()


def test_stratified_folds_are_even(skewed):
    df, _ = skewed
    for prefix in (1, 3):
        sizes = stratified_kfold(df.drop("fold"), "id", "entity", prefix=prefix) \
            .groupBy("entity", "fold").count().collect()
        by_class = {}
        for r in sizes:
            by_class.setdefault(r["entity"], {})[r["fold"]] = r["count"]
        for counts in by_class.values():
            filled = [counts.get(k, 0) for k in range(5)]
            assert max(filled) - min(filled) <= 1


def test_moments_per_slot(skewed):
    df, pdf = skewed
    got = fit_moments(df, ["x"], Slots("fold", 5))["x"]
    for k in range(6):
        part = pdf.x[pdf.fold != k]
        assert got[k].variance == pytest.approx(part.var())
        assert got[k].skew == pytest.approx(part.skew())
        assert got[k].low == part.min()


@pytest.mark.parametrize("rows", [400])
def test_sampled_sketch_stays_exact(skewed, monkeypatch, rows):
    """A poor sample costs passes, never a result."""
    monkeypatch.setattr(q, "SKETCH_ROWS", rows)
    monkeypatch.setattr(q, "MAX_INSIDE", 60)
    df, pdf = skewed
    got = q.slot_quantiles(df, {"x": F.col("x")}, [0.1, 0.5, 0.9], Slots("fold", 5))["x"]
    for k in range(6):
        np.testing.assert_allclose(got[k], np.quantile(pdf.x[pdf.fold != k], [0.1, 0.5, 0.9]))
    out = event_history(df, ["entity"], "at", "id", F.col("flag") == 1, rows_per_piece=200)
    assert {r["id"]: (r["cum_count"], r["since_last"]) for r in out.collect()} == _history(pdf)
