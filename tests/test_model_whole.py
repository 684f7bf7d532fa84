"""The whole model: all its rounds, grown by one task a part or by passes of many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators import boosting
from foldmark.operators.boosting import ModelParams
from foldmark.operators.model import fit_model, fit_models
from foldmark.plans.catalog import modelling
from foldmark.plans.evaluation import EvalResult

BOOSTED = dict(depth=3, rate=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    """Three numbers, one with gaps, and labels of each kind."""
    base = spark.range(0, 1500, numPartitions=3).select(
        "id", (F.col("id") * 7919 % 601).cast("double").alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 31 % 17).cast("double")).alias("b"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("noise"))
    score = F.col("a") / 100 + F.coalesce("b", F.lit(3.0)) / 4 + F.col("noise")
    return base.withColumns({"regression": score, "binary": (score > 5).cast("double"),
                             "multiclass": F.when(score < 4, 0.0).when(score < 6, 1.0).otherwise(2.0)}).cache()


def test_cv_fit_predict_asks_for_the_whole_model(monkeypatch):
    asked = []
    monkeypatch.setattr(modelling.fx, "order_spec", lambda *a: type("Spec", (), {"task_text": "", "problem_type": "binary"}))
    monkeypatch.setattr(modelling, "cross_validate",
                        lambda *a, params, **k: asked.append(params) or EvalResult(False, error="seen"))
    with pytest.raises(RuntimeError, match="seen"):
        modelling.cv_fit_predict(None, "")
    assert [(p.rounds, p.depth, p.rate, p.subsample, p.patience) for p in asked] == [(2000, 6, 0.03, 0.85, 150)]


def test_rounds_go_on_while_the_held_out_loss_falls(spark):
    df = spark.range(0, 400, numPartitions=2).select("id", F.col("id").cast("double").alias("a"),
                                                     (F.col("id") * 2.0).alias("y"))
    model = fit_model(df.filter("id % 4 <> 0"), ["a"], "y", "regression",
                      holdout=df.filter("id % 4 = 0"), key="id").boosted
    assert len(model.trees) > 200
    assert len(model.losses) == min(2000, int(np.argmin(model.losses)) + 150) + 1
    # without rows held out, every round counts
    assert fit_model(df.limit(40), ["a"], "y", "regression", key="id").n_trees == 2000


@pytest.mark.parametrize("problem", ["regression", "binary", "multiclass"])
def test_one_task_a_part_grows_the_trees_of_many_passes(rows, monkeypatch, problem):
    parts = {2: (rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")), 5: (rows.filter("id % 2 = 0"), None),
             9: (rows.filter("id % 4 <> 0 AND id < 300"), rows.filter("id % 4 = 0"))}

    def fitted(**more):
        found = fit_models(parts, ["a", "b", "noise"], problem, problem,
                           ModelParams(rounds=12, patience=4, **BOOSTED), 3, "id")
        return {p: m.boosted for p, m in found.items()}

    whole = fitted()
    monkeypatch.setattr(boosting, "WHOLE_BYTES", 0)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 5)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 900)
    spread = fitted()
    assert sorted(whole) == sorted(spread) == [2, 5, 9]
    for p in whole:
        assert [(t.features, t.bins) for t in whole[p].trees] == [(t.features, t.bins) for t in spread[p].trees]
        assert all(np.allclose(a.values, b.values) for a, b in zip(whole[p].trees, spread[p].trees))
        assert whole[p].losses == pytest.approx(spread[p].losses)
    assert not whole[5].losses and len(whole[5].trees) == 12


def test_the_layout_of_rows_does_not_change_a_model(rows):
    one, other = (fit_model(df, ["a", "b", "noise"], "binary", "binary", ModelParams(rounds=8, **BOOSTED),
                            key="b").boosted for df in (rows.coalesce(1), rows.orderBy("noise").repartition(5)))
    assert all(a.features == b.features and a.bins == b.bins and (a.values == b.values).all()
               for a, b in zip(one.trees, other.trees))
    assert len(one.trees) == len(other.trees) == 8


def test_each_part_has_a_task_of_its_own(spark, rows):
    from pyspark import TaskContext

    def made(batches):
        import pyarrow as pa
        seen = {p for b in batches for p in b.column("part").to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(seen), pa.int32()),
                                          pa.array(sorted(seen), pa.int32())], ["task", "part"])

    some = rows.select((F.col("id") % 5).cast("int").alias("part"))
    got = some.repartitionById(5, boosting.own_task([0, 1, 2, 3, 4])).mapInArrow(made, "task int, part int").collect()
    assert sorted((r["task"], r["part"]) for r in got) == [(k, k) for k in range(5)]
