import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from foldmark.llm import search as se

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        ranked = []
        for doc, c in held:
            n = sum(c.values())
            score = 0
            for t in words(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=repr)


def table(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["naïve", "ÉTÉ", "été", "the", "The", "x-y", "a_b", "数", "é" * 30]
    text = lambda k: rng.choice([" ", ", ", "\n", "—"]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(n)]
    docs += [(500 + i, docs[3][1]) for i in range(60)]      # ties beyond the cut
    docs += [(None, docs[3][1]), (None, docs[4][1]), (700, None), (701, ""), (702, ".,; \n"), (5, docs[5][1]),
             (5, docs[5][1]), (800, "the w1 " * 60_000)]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(25)]
    items += [(90, None), (91, "?!"), (92, "unseen"), (93, "the the the w1"), (93, "w1 the the the"), (None, "w3 w4")]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 9, "q") for r in docs], "doc_id long, text string, n int, _item string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in se.search(d.repartition(5), i, **more).collect()], key=repr)


def test_equals_brute_force(spark):
    docs, items = table()
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_small_blocks_and_batches_change_nothing(spark, monkeypatch):
    docs, items = table(8, 60)
    monkeypatch.setattr(se, "BLOCK_ITEMS", 7)
    assert run(spark, docs, items) == brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=15), max_size=12))
def test_shared_sets_add_up_to_the_items(lists):
    needs = [Counter(x) for x in lists]
    plan = se.plan_of(needs)
    part = np.random.default_rng(0).integers(0, 1000, (13, 5))
    want = [sum((part[t] * q for t, q in need.items()), np.zeros(5, np.int64)) for need in needs]
    got = se.scores(plan, part)
    assert all((g == w).all() for g, w in zip(got, want))


def test_sets_that_items_share_are_computed_once():
    plan = se.plan_of([Counter(range(10)), Counter(range(10)), Counter([*range(10), 20]), Counter([30])])
    assert len(plan.parts) == 9 and [len(i) for i in plan.items] == [1, 1, 2, 1]


def test_best_keeps_the_smallest_keys_of_equal_scores():
    best = se.Best(1, 3)
    for keys in ([9, 8], [7, 1], [5, 2]):
        best.add(np.array([[4, 4]]), np.zeros(2, np.int64), np.array(keys))
    assert best.rows[0][2].tolist() == [1, 2, 5]


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_nothing_to_find(spark, docs, items):
    assert run(spark, docs, items) == []
