import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators.boosting import ModelParams, best_split
from foldmark.operators.metrics import METRICS
from foldmark.operators.model import fit_model, fit_models
from foldmark.operators.ordered import fit_ordered, piece_of

FEW = ModelParams(rounds=6, depth=3, rate=0.3, subsample=1.0)


def auc(df):
    """By ranks, ties counted half."""
    rows = sorted((r["pred"], r["y"]) for r in df.collect())
    p = np.array([a for a, _ in rows])
    y = np.array([b for _, b in rows])
    rank = (np.searchsorted(p, p, "left") + np.searchsorted(p, p, "right") + 1) / 2
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def wide(spark):
    """A column of 1,000 levels that decides the label, and noise."""
    rows = spark.range(20_000).select(
        "id", F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")).alias("level"),
        F.rand(3).alias("noise"))
    return rows.withColumn("y", (F.pmod(F.xxhash64("level", F.lit(7)), F.lit(2)) == 0).cast("double"))


def test_a_category_of_a_thousand_levels_decides(wide):
    params = ModelParams(rounds=10, rate=0.3)
    model = fit_model(wide.filter("id % 4 <> 0"), ["level", "noise"], "y", "binary", params, key="id")
    assert model.features == ["noise", "level"]
    assert auc(model.predict(wide.filter("id % 4 = 0"))) > 0.95
    # a label that the levels know nothing of is not learnt through the statistics
    blind = wide.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0).cast("double"))
    model = fit_model(blind.filter("id % 4 <> 0"), ["level"], "y", "binary", params, key="id")
    assert abs(auc(model.predict(blind.filter("id % 4 = 0"))) - 0.5) < 0.03


def test_ordered_statistics_equal_plain_sums(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"l{i % 5}", float(i % 3)) for i in range(200)],
                                 "id long, c string, y double").withColumn("p", piece_of([F.col("id")], 8))
    stats = fit_ordered(rows, ["c"], F.col("y"), F.col("p"), 3, 8, weight=2.0)
    got = stats.transform(rows, F.col("id"), F.col("p")).collect()
    for r in got:
        before = [x for x in got if x["p"] < r["p"]]
        prior = before or [x for x in got if x["p"] > 0]
        same = [x for x in before if x["c"] == r["c"]]
        for k in range(3):
            mean = sum(x["y"] == k for x in prior) / len(prior)
            want = (sum(x["y"] == k for x in same) + 2.0 * mean) / (len(same) + 2.0)
            assert r[f"__ts_0_{k}"] == pytest.approx(want)
    new = spark.createDataFrame([(1, "unseen")], "id long, c string")
    share = sum(x["y"] == 1 for x in got) / len(got)
    assert stats.transform(new, F.col("id")).first()["__ts_0_1"] == pytest.approx(share)


def plain_boost(x, y, rounds, depth, rate, penalty, problem, k):
    """Symmetric trees by trying every split on every value."""
    n = len(y)
    if problem == "regression":
        s = np.full((n, 1), y.mean())
    elif problem == "binary":
        s = np.full((n, 1), np.log(y.mean() / (1 - y.mean())))
    else:
        c = np.bincount(y.astype(int), minlength=k) + 1.0
        s = np.tile(np.log(c / c.sum()), (n, 1))
    for _ in range(rounds):
        if problem == "regression":
            g, h = s - y[:, None], np.ones((n, 1))
        elif problem == "binary":
            p = 1 / (1 + np.exp(-s))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
            g, h = p - np.eye(k)[y.astype(int)], p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            best = (1e-12, None)
            for f in range(x.shape[1]):
                for cut in [-np.inf, *np.unique(x[~np.isnan(x[:, f]), f])[:-1]]:
                    up = np.nan_to_num(x[:, f], nan=-np.inf) > cut
                    gain = 0.0
                    for o in range(s.shape[1]):
                        for i in range(1 << level):
                            both = node == i
                            for at, sign in ((both & up, 1), (both & ~up, 1), (both, -1)):
                                gain += sign * g[at, o].sum() ** 2 / (h[at, o].sum() + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
            if best[1] is None:
                break
            f, cut = best[1]
            node |= (np.nan_to_num(x[:, f], nan=-np.inf) > cut).astype(int) << level
        for i in range(1 << depth):
            at = node == i
            if at.any():
                s[at] += -rate * g[at].sum(axis=0) / (h[at].sum(axis=0) + penalty)
    return s


@pytest.mark.parametrize("problem,k", [("regression", 1), ("binary", 1), ("multiclass", 3)])
def test_trees_equal_plain_boosting(spark, problem, k):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    x[rng.random(300) < 0.2, 1] = np.nan
    score = x[:, 0] + 2 * np.nan_to_num(x[:, 1]) + rng.normal(0, 1, 300)
    y = score if problem == "regression" else (score > np.median(score)).astype(float)
    if k == 3:
        y = np.digitize(score, np.quantile(score, [0.3, 0.6])).astype(float)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    model = fit_model(df.repartition(3), ["a", "b", "c"], "y", problem, FEW, n_classes=k, key="id")
    want = plain_boost(x, y, 6, 3, 0.3, FEW.penalty, problem, k)
    got = np.array(model.boosted.scores([x[:, j] for j in range(3)]))
    assert np.allclose(got, want, atol=1e-8)
    pred = {r["id"]: r["pred"] for r in model.predict(df).collect()}
    if k == 3:
        assert all(sum(p) == pytest.approx(1.0) and len(p) == 3 for p in pred.values())
        right = sum(int(np.argmax(pred[i])) == int(t) for i, t in enumerate(y))
        assert right > 240
    assert len(pred) == 300


def test_stops_on_a_plateau_where_the_whole_curve_is_least(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 4)), float(rng.random())) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, noise double").withColumn(
        "y", (F.col("a") >= 2).cast("double") + 0.5 * F.pmod(F.xxhash64("id"), F.lit(2)))
    train, held = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    deep = dict(depth=2, rate=0.8, subsample=1.0, penalty=0.0)
    whole = fit_model(train, ["a", "noise"], "y", "regression",
                      ModelParams(rounds=14, patience=99, **deep), held, key="id").boosted
    early = fit_model(train, ["a", "noise"], "y", "regression",
                      ModelParams(rounds=14, patience=3, **deep), held, key="id").boosted
    assert len(whole.losses) == 15
    best = next(i for i in range(15) if i + 3 <= 14 and min(whole.losses[i:i + 4]) == whole.losses[i])
    assert len(early.losses) == best + 4 < 15
    assert early.losses == pytest.approx(whole.losses[:len(early.losses)])
    assert len(early.trees) == max(1, int(np.argmin(early.losses)))
    assert len(whole.trees) == max(1, int(np.argmin(whole.losses)))


def test_parts_in_step_equal_each_alone(wide):
    a, b = wide.filter("id % 2 = 0"), wide.filter("id % 2 = 1")
    both = fit_models({3: (a, None), 8: (b, a)}, ["level", "noise"], "y", "binary",
                      ModelParams(rounds=12, depth=2), key="id")
    alone = fit_model(b, ["level", "noise"], "y", "binary", ModelParams(rounds=12, depth=2), a, key="id")
    x = [np.array([0.1, 0.9, np.nan]), np.array([0.3, 0.6, 0.2])]
    assert np.allclose(both[8].boosted.scores(x), alone.boosted.scores(x))
    assert both[8].boosted.losses == pytest.approx(alone.boosted.losses)
    assert not both[3].boosted.losses and both[3].n_trees == 12


def test_many_tasks_and_passes_give_the_same(wide, monkeypatch):
    from foldmark.operators import boosting
    args = (wide.limit(3000), ["level", "noise", "id"], "y", "binary", ModelParams(rounds=3, depth=3))
    want = fit_model(*args).boosted
    monkeypatch.setattr(boosting, "SUMS_BYTES", 1)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 700)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 1)
    got = fit_model(*args).boosted
    assert [(t.features, t.bins) for t in got.trees] == [(t.features, t.bins) for t in want.trees]
    assert all(np.allclose(a.values, b.values) for a, b in zip(got.trees, want.trees))


def test_nothing_to_split_and_missing_labels(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, None, None)], "id long, a double, y double")
    model = fit_model(df, ["a"], "y", "regression", FEW)
    assert [r["pred"] for r in model.predict(df).collect()] == [2.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        fit_model(df, [], "y", "regression", FEW)
    b, gain, sides = best_split(np.zeros((1, 2, 1, 4)), 1.0)
    assert (b, gain) == (0, 0.0) and sides.shape == (2, 1, 2, 1)


def test_metric_names_are_known():
    assert {"auc", "mlogloss"} <= set(METRICS)
