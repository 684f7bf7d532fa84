import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from foldmark.llm import fingerprints as fp


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collisions_follow_weighted_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    errors = []
    for _ in range(60):
        a = rng.choices(words, k=rng.randint(5, 400), weights=range(1, 301))
        b = a[:rng.randint(0, len(a))] + rng.choices(words, k=rng.randint(1, 200))
        x, y = fp.signatures(pa.array([" ".join(a), " ".join(b)]), 256)
        errors.append(fp.likeness(x, y) - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 0.15


def test_hashing_does_not_grow_with_texts(monkeypatch):
    """Words are hashed once for all texts; every text gets what it gets alone."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(words + rng.choices(words, k=40)) for _ in range(60)] + ["", None, "a a b"]
    calls = []
    mix = fp.bt.mix

    def counted(*args, **more):
        calls.append(1)
        return mix(*args, **more)

    monkeypatch.setattr(fp.bt, "mix", counted)
    together = fp.signatures(pa.array(texts))
    assert len(calls) < len(texts)
    alone = [fp.signatures(pa.array([t], pa.string()))[0] for t in texts]
    assert (together == np.array(alone)).all()


def report(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    got = fp.edit_report(docs.repartition(3)).collect()
    return sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_edited_texts_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choices(["aé", "b", "🙂c", "d\n"], k=rng.randint(0, 60)))) for i in range(50)]
    rows[7] = (21, None)
    got = report(spark, rows)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for k, r in enumerate(got):
        own, following = rows[k][1] or "", rows[(k + 1) % 50][1] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = (fp.signatures(pa.array([t]))[0] for t in (own, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fp.shown(a), fp.shown(e))
        assert (r.near_edited, r.near_next) == (fp.likeness(a, e), fp.likeness(a, n))


def test_edges(spark):
    assert report(spark, []) == []
    one = report(spark, [(4, "only one text")])
    assert len(one) == 1 and one[0].near_next == 1.0
    some = report(spark, [(None, "x y"), (1, ""), (1, None), (2, "a b c d " * 9000)])
    assert [r.doc_id for r in some] == [None, 1, 1, 2]
    assert some[1].fingerprint == "0" * 512 and some[1].near_next == 1.0
