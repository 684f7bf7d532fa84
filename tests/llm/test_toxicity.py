import random

import numpy as np
from pyspark.sql import functions as F

from foldmark.llm import toxicity
from foldmark.llm.toxicity import BlockMaxIndex, Settings, isotonic


def test_index_is_exact():
    rng = random.Random(1)
    def row():
        r = {rng.randrange(40): rng.random() for _ in range(rng.randint(0, 6))}
        norm = sum(w * w for w in r.values()) ** 0.5
        return {t: w / norm for t, w in r.items()}
    rows = [row() for _ in range(500)] + [{3: 1.0}] * 40
    index = BlockMaxIndex(rows, 40, 16)
    for _ in range(200):
        q = row()
        want = sorted(((-sum(w * rows[i].get(t, 0) for t, w in q.items()), at)
                       for at, i in enumerate(index.order)))
        want = [(at, -s) for s, at in want if s < 0][:7]
        at, near = index.nearest(q, 7)
        assert np.allclose(near, [s for _, s in want])
        assert len(set(at.tolist()) ^ {a for a, _ in want}) == 0 or np.isclose(near[-1], want[-1][1])


def test_votes_equal_brute_force():
    rng = random.Random(7)
    names = [f"w{i}" for i in range(30)]
    idf = np.array([1 + rng.random() for _ in names])
    def counts():
        return {t: rng.randint(1, 4) for t in rng.sample(range(30), rng.randint(0, 5))}
    examples = [(i, int(rng.random() < 0.4), counts()) for i in range(300)]
    settings = Settings(neighbours=5, block=16)
    s = toxicity.Scorer(dict(zip(names, range(30))), idf, examples, {0: 900.0, 1: 100.0}, settings)

    def unit(c):
        v = np.zeros(30)
        for t, n in c.items():
            v[t] = (1 + np.log(n)) * idf[t]
        return v / (np.sqrt((v * v).sum()) or 1)
    rows = np.array([unit(examples[i][2]) for i in s.index.order])
    toxic = np.array([examples[i][1] for i in s.index.order])

    def vote(query, own=-1):
        near = np.round(rows @ query, 9)
        best = [i for i in np.argsort(-near, kind="stable") if near[i] > 0 and i != own][:5]
        return (near[best] * toxic[best]).sum() / (near[best].sum() + settings.smoothing)
    votes = np.array([round(vote(r, i), 9) for i, r in enumerate(rows)])
    n = np.bincount(toxic)
    steps, values = isotonic(votes, toxic.astype(float), np.array([900 / n[0], 100 / n[1]])[toxic])
    asked = [counts() for _ in range(700)] + [{}]
    texts = [" ".join(w for t, k in c.items() for w in [names[t]] * k) + " other" for c in asked]
    for c, (score, evidence) in zip(asked, s.scores(texts)):
        want = values[max(np.searchsorted(steps, round(vote(unit(c)), 9), side="right") - 1, 0)]
        assert np.isclose(score, want)
        near = np.sort(rows @ unit(c))[::-1][:3]
        assert np.allclose([e[1] for e in evidence], near[near > 0])


def test_isotonic_rises():
    x = np.array([0, 0, 1, 2, 3, 3, 4.0])
    steps, values = isotonic(x, np.array([0, 1, 0, 1, 0, 1, 1.0]), np.ones(7))
    assert (np.diff(values) >= 0).all() and steps[0] == 0 and values[-1] == 1


def test_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs.withColumn("toxic", F.lit(1)), labels)
    both = got.join(labels, "doc_id").toPandas()
    test = both[both.held_out]
    assert got.count() == docs.count() and both.score.between(0, 1).all()
    assert (test.predicted == test.toxic).mean() > 0.95
    assert ((test.predicted == 1) & (test.toxic == 1)).sum() >= 0.85 * (test.toxic == 1).sum()


def test_a_text_scores_the_same_under_any_id(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10 ** 7))
    got = {r.doc_id: r.score for r in toxicity.scored(twice, labels).collect()}
    assert len(got) == 2 * docs.count() and len(set(got.values())) > 1
    assert all(got[i] == got[i + 10 ** 7] for i in got if i < 10 ** 7)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, none, Settings()).toPandas()
    assert len(got) == 4 and (got.score == 0).all() and (got.predicted == 0).all()
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.scored(docs, odd).count() == 4
    assert toxicity.scored(docs.limit(0), odd).count() == 0
