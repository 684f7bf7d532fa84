import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators.boosting import ModelParams
from foldmark.operators.calibrate import calibrated
from foldmark.operators.folds import group_kfold, time_blocks
from foldmark.operators.framing import ProblemSpec
from foldmark.operators.metrics import METRICS
from foldmark.plans.contract import FOLD, KEY, LABEL, Solution
from foldmark.plans.evaluation import Splits, adversarial_validation, cross_validate
from foldmark.plans.recipes import PassThrough

FEW = ModelParams(rounds=4, depth=3, rate=0.3)


def test_groups_stay_together_and_folds_are_even(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", f"g{rng.randint(0, 300)}", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = group_kfold(df, "g", "id", 4).collect()
    assert len(got) == 4000
    folds = {}
    for r in got:
        if r["g"] is not None:
            folds.setdefault(r["g"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    sizes = [sum(r["fold"] == k for r in got) for k in range(4)]
    hot = sum(g == "hot" for _, g in rows)
    rest = (4000 - hot) / 3
    assert sorted(sizes)[-1] == hot and all(abs(s - rest) <= 40 for s in sorted(sizes)[:3])
    assert sorted((r["id"], r["fold"]) for r in group_kfold(df.repartition(3), "g", "id", 4).collect()) == \
        sorted((r["id"], r["fold"]) for r in got)


def test_training_rows_are_never_later(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 50 > 0, F.timestamp_seconds(
        F.least(F.col("id") * 7 % 900, F.lit(600)))).alias("at"))
    got = time_blocks(rows, "at", 4)
    spans = {r["fold"]: (r["lo"], r["hi"], r["n"]) for r in got.groupBy("fold").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("at").alias("n")).collect()}
    for k in sorted(spans)[1:]:
        assert all(spans[j][1] < spans[k][0] for j in spans if j < k)
    assert got.count() == 1000 and got.filter("at IS NULL AND fold <> 0").count() == 0


class _Remembers(Solution):
    """Notes the latest time it was fitted on."""
    seen: list = []

    def fit(self, train, spec, slots):
        self.seen.append(train.agg(F.max("at")).first()[0])

    def transform(self, df, holdout=None):
        return df.select(*[c for c in (KEY, FOLD) if c in df.columns], "x")


def _spec(df, target="y"):
    return ProblemSpec("", "", target, "id", "binary", 2, [0, 1], df, df.drop(target).limit(0))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1200).select(
        "id", F.concat(F.lit("g"), F.col("id") % 17).alias("g"), F.timestamp_seconds(F.col("id") * 60).alias("at"),
        F.rand(3).alias("x")).withColumn("y", (F.col("x") + F.rand(4) * 0.3 > 0.6).cast("int"))


def test_cross_validation_in_time_and_by_group(rows):
    by_time = cross_validate(_Remembers(), _spec(rows), METRICS["auc"], 3, params=FEW, splits=Splits(time="at"))
    assert by_time.ok, by_time.error
    tested = by_time.oof.groupBy(FOLD).agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).orderBy(FOLD).collect()
    assert [r[FOLD] for r in tested] == [1, 2, 3] and len(_Remembers.seen) == 3
    starts = {r["id"]: r["at"] for r in rows.select("id", "at").collect()}
    assert all(seen < starts[r["lo"]] for seen, r in zip(_Remembers.seen, tested))
    assert by_time.summary.first()["score"] > 0.8
    grouped = cross_validate(PassThrough(), _spec(rows.drop("at")), METRICS["auc"], 3, params=FEW, splits=Splits(groups="g"))
    assert grouped.ok, grouped.error
    joined = grouped.oof.join(rows, F.col(KEY) == F.col("id"))
    assert joined.groupBy("g").agg(F.count_distinct(FOLD).alias("k")).filter("k > 1").count() == 0


def test_membership_is_hidden_or_seen(rows):
    plain = rows.select("id", "x", "g", "y")
    split = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    same = adversarial_validation(ProblemSpec("", "", "y", "id", "binary", 2, [0, 1], plain.filter(split),
                                              plain.filter(~split).drop("y")), PassThrough(), 3, params=FEW)
    assert same.ok and abs(same.summary.first()["score"] - 0.5) < 0.1
    shifted = adversarial_validation(ProblemSpec("", "", "y", "id", "binary", 2, [0, 1], plain.filter("x < 0.52"),
                                                 plain.filter("x > 0.48").drop("y")), PassThrough(), 3, params=FEW)
    assert shifted.ok and shifted.summary.first()["score"] > 0.9
    assert shifted.importance.orderBy(F.desc("importance")).first()["feature"] == "x"


def plain_isotonic(p, y):
    """Least squares over non-decreasing functions, by the max-min formula."""
    xs = sorted(set(p))
    s = [sum(b for a, b in zip(p, y) if a == x) for x in xs]
    n = [p.count(x) for x in xs]
    cum_s, cum_n = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    fit = [max(min((cum_s[j + 1] - cum_s[i]) / (cum_n[j + 1] - cum_n[i]) for j in range(k, len(xs)))
               for i in range(k + 1)) for k in range(len(xs))]
    return xs, fit


def test_isotonic_equals_plain_code_on_the_other_folds(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.random(), 2) if i % 9 else 0.5, 0, i % 3) for i in range(500)]
    rows = [(i, p, int(rng.random() < p ** 2), f) for i, p, _, f in rows]
    df = spark.createDataFrame(rows + [(900, None, 1, 0), (901, 0.3, None, 1)], "id long, p double, y int, fold int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        got = {r["id"]: r["calibrated"] for r in calibrated(df, "p", "y", "fold", 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for f in range(3):
        others = [(p, y) for _, p, y, g in rows if g != f]
        xs, fit = plain_isotonic([p for p, _ in others], [y for _, y in others])
        for i, p, _, g in rows:
            if g == f:
                assert got[i] == pytest.approx(np.interp(p, xs, fit), abs=1e-9)
    assert got[900] is None and got[901] is not None and len(got) == 502


def test_a_label_does_not_reach_its_own_calibration(spark):
    rows = [(i, i / 100, i % 2, i % 4) for i in range(100)]
    flipped = [(i, p, 1 - y if f == 2 else y, f) for i, p, y, f in rows]
    schema = "id long, p double, y int, fold int"
    a, b = ({r["id"]: r["calibrated"] for r in calibrated(spark.createDataFrame(x, schema), "p", "y", "fold", 4).collect()}
            for x in (rows, flipped))
    assert all(a[i] == pytest.approx(b[i]) for i, _, _, f in rows if f == 2)
    assert any(abs(a[i] - b[i]) > 1e-6 for i, _, _, f in rows if f != 2)


def test_key_needs_to_be_unique(rows):
    twice = rows.unionAll(rows.limit(1))
    result = cross_validate(PassThrough(), _spec(twice), METRICS["auc"], 3, params=FEW)
    assert not result.ok and "key" in result.error
    assert LABEL not in rows.columns
