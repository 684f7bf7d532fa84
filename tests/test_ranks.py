import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators.neighbours import interval, neighbour_information, psi
from foldmark.operators.ranks import percent_ranks, spearman, spearman_top


def average_ranks(v):
    order = sorted(v)
    return [sum(i + 1 for i, x in enumerate(order) if x == w) / order.count(w) for w in v]


def test_spearman_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.0, 5.5, rng.random()]), rng.randint(0, 3), 7.0,
             rng.choice([None, float(i), 3.0, 3.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b int, flat double, y double")
    got = {r["column"]: (r["n"], r["corr"]) for r in spearman(df.repartition(7), "y").collect()}
    for j, c in ((0, "id"), (1, "a"), (2, "b")):
        pairs = [(r[j], r[4]) for r in rows if r[j] is not None and r[4] is not None]
        want = np.corrcoef(average_ranks([p[0] for p in pairs]), average_ranks([p[1] for p in pairs]))[0, 1]
        assert got[c][0] == len(pairs) and got[c][1] == pytest.approx(want)
    assert got["flat"][1] is None
    assert [r["column"] for r in spearman_top(df, "y", 1).collect()] == ["id"]


def test_percent_ranks_with_a_hot_value(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.5, 0.5, 0.5, rng.random(), None]), i % 3) for i in range(900)] + [(901, 0.1, 9)]
    df = spark.createDataFrame(rows, "id long, p double, fold int")
    got = {r["id"]: (r["p"], r["r"], r["g"]) for r in
           percent_ranks(percent_ranks(df, "p", "r"), "p", "g", ["fold"]).collect()}
    present = [p for _, p, _ in rows if p is not None]
    assert len(got) == 901
    for i, p, f in rows:
        if p is None:
            assert got[i][1] is None and got[i][2] is None
            continue
        own = [q for _, q, g in rows if g == f and q is not None]
        assert got[i][1] == pytest.approx(sum(q < p for q in present) / (len(present) - 1))
        assert got[i][2] == pytest.approx(sum(q < p for q in own) / (len(own) - 1) if len(own) > 1 else 0.0)
    assert percent_ranks(df.filter("id < 0"), "p", "r").count() == 0


def brute(x, y, k=3):
    digamma = lambda n: -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))
    size = {c: y.count(c) for c in y}
    rows = [(a, c) for a, c in zip(x, y) if size[c] > 1]
    total = []
    for i, (a, c) in enumerate(rows):
        near = min(k, size[c] - 1)
        r = sorted(abs(b - a) for j, (b, d) in enumerate(rows) if d == c and j != i)[near - 1]
        m = sum(abs(b - a) < r or b == a for b, _ in rows)
        if r == 0:
            near = sum(b == a and d == c for b, d in rows)
        total.append(digamma(near) - digamma(size[c]) - digamma(m))
    return len(rows), max(0.0, digamma(len(rows)) + sum(total) / len(total))


@pytest.mark.parametrize("pieces", [2, 40])
def test_neighbour_information_equals_brute_force(spark, pieces):
    rng = random.Random(3)
    n = 2000 if pieces == 2 else 300
    y = [rng.choice("aaab") if i else "alone" for i in range(n)]
    x = [round(rng.gauss(3 if c == "b" else 0, 1), 2) for c in y]
    z = [rng.choice([0.0, 1.0]) for _ in y]
    df = spark.createDataFrame(list(zip(x, z, y)), "x double, z double, y string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        got = {r["column"]: (r["n"], r["mutual_info"]) for r in neighbour_information(df, ["x", "z"], "y").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c, v in (("x", x), ("z", z)):
        n, want = brute(v, y)
        assert got[c][0] == n and got[c][1] == pytest.approx(want, abs=1e-9)
    assert got["x"][1] > 0.2 and got["z"][1] < 0.02


def test_neighbours_leave_out_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, "a"), (3.0, "a"), (float("nan"), "a"), (4.0, "a")],
                               "x double, y string")
    assert neighbour_information(df, ["x"], "y").first()["n"] == 4
    assert neighbour_information(df.filter("x > 99"), ["x"], "y").count() == 0


def test_interval_and_psi(spark):
    rng = np.random.default_rng(0)
    x, other = rng.normal(0, 1e3, 2000).round(2), rng.normal(0, 1e3, 2000).round(2)
    r = np.abs(other - x)
    above, below = interval(x, r)
    for t, sign in ((above, 1), (below, -1)):
        assert (np.abs(t - x) >= r).all()
        assert (np.abs(np.nextafter(t, -sign * np.inf) - x) < r).all()
    got = spark.range(1, 60).select("id", psi(F.col("id")).alias("p")).collect()
    for row in got:
        want = -0.5772156649015329 + math.fsum(1 / i for i in range(1, row["id"]))
        assert row["p"] == pytest.approx(want, abs=1e-12)
