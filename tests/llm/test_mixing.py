import math

import pytest

from foldmark.llm import mixing
from foldmark.llm.mixing import Mixture


def table(spark, sizes):
    rows = [(1000 * k + i, "w " * (3 + (i * 7 + k) % 11), s, 1) for k, (s, n) in enumerate(sizes.items())
            for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").repartition(3)


def solved(held, enough):
    """Plain bisection of the exponent."""
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        w = [h ** a for h in held]
        w = [x / sum(w) for x in w]
        low, high = (low, a) if enough(w) else (a, high)
    return high


@pytest.mark.parametrize("mix", [Mixture(budget=1.0, max_repeats=3.0), Mixture(budget=.8, max_repeats=1.0),
                                 Mixture(budget=.5, max_repeats=None, entropy=.8)])
def test_weights_meet_the_target(spark, mix):
    docs = table(spark, {"big": 300, "mid": 60, "low": 9, None: 20})
    held = {}
    for r in docs.collect():
        held[r.source] = held.get(r.source, 0) + len(r.text.split()) + 1
    total = sum(held.values())
    sizes = list(held.values())
    if mix.entropy is None:
        a = solved(sizes, lambda w: max(mix.budget * total * x / h for x, h in zip(w, sizes)) <= mix.max_repeats)
    else:
        a = solved(sizes, lambda w: -sum(x * math.log(x) for x in w) / math.log(len(w)) <= mix.entropy)
    norm = sum(h ** a for h in sizes)
    rows = mixing.mixed(docs, Mixture(mix.budget, mix.max_repeats, mix.entropy, 400, 3)).collect()
    taken, copies = {}, {}
    for r in rows:
        assert r.weight == pytest.approx(held[r.source] ** a / norm, rel=1e-6)
        taken[r.source] = taken.get(r.source, 0) + r.tokens
        copies.setdefault(r.source, {}).setdefault(r.doc_id, set()).add(r["pass"])
    for s, h in held.items():
        owed = mix.budget * total * h ** a / norm
        assert owed <= taken[s] + 1e-3 and taken[s] < owed + 15
        # a pass begins only when the one before has read every document
        n = [len(c) for c in copies[s].values()]
        assert max(n) - min([*n, 0] if len(n) < sum(1 for r in docs.collect() if r.source == s) else n) <= 1
    for b in {r.block for r in rows}:
        inside = [r for r in rows if r.block == b]
        assert sorted(r.slot for r in inside) == list(range(len(inside)))


def test_rows_of_documents(spark):
    docs = table(spark, {"a": 50, "b": 5})
    got = mixing.mixed_documents(docs, Mixture(budget=1.0, max_repeats=2.0))
    assert got.columns == docs.columns
    n = {s: sum(r.source == s for r in got.collect()) for s in "ab"}
    assert n["b"] == 10 and 40 < n["a"] < 50


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "x", None)], "doc_id long, text string, source string")
    assert mixing.mixed(docs).count() >= 3
    assert mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Mixture(budget=2.0, max_repeats=1.0)


def test_rows_without_an_id_are_taken_as_often_as_the_mixture_reads_them(spark):
    rows = [(None, "w " * 4, "a", i, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int, _row int")
    mix = Mixture(budget=0.3, max_repeats=1.0)
    n = mixing.mixed(docs, mix).count()
    got = mixing.mixed_documents(docs, mix)
    assert got.columns == docs.columns and got.count() == n and 29 <= n <= 31
    assert len({r["_key"] for r in got.collect()}) == n


def test_no_budget_reads_nothing(spark):
    docs = table(spark, {"a": 20, "b": 5})
    assert mixing.mixed(docs, Mixture(budget=0.0)).count() == 0
    assert mixing.mixed_documents(docs, Mixture(budget=0.0)).count() == 0


def test_documents_are_the_copies_of_the_mixture(spark):
    docs = table(spark, {"big": 200, "low": 7}).unionAll(spark.createDataFrame(
        [(9, "long " * 200_000, "low", 1)], "doc_id long, text string, source string, slot int"))
    mix = Mixture(budget=1.0, max_repeats=3.0)
    want, got = {}, {}
    for r in mixing.mixed(docs, mix).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + 1
    for r in mixing.mixed_documents(docs, mix).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert sum(got.values()) == sum(want.values()) and set(got) == set(want)
