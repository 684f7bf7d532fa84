import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from foldmark.llm import manifest as mf

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(level):
    """All levels, from the leaves to the root."""
    levels = [level]
    while len(level) > 1:
        level = [sha(level[i:i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        members.append(mine)
        trees.append(tree([leaf(r) for r in mine]))
    top = tree([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for g, (mine, levels) in enumerate(zip(members, trees)):
        for i, r in enumerate(mine):
            steps = []
            for lv, at in ((levels, i), (top, g)):
                for level in lv[:-1]:
                    run = level[at // 3 * 3:at // 3 * 3 + 3]
                    steps.append((run, at % 3))
                    at //= 3
            proof = sha(x for run, k in steps for j, x in enumerate(run) if j != k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf((*r[:4], text))
            for run, k in steps:
                h = sha(run[:k] + [h] + run[k + 1:])
            out.append((r[0], leaf(r), levels[-1][0], root, proof, h, h == root))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


def rows(n):
    out = [(i * 7 % 1000, "hot" if i % 3 else f"s{i % 11}", "en", i, f"text {i}\nline" * (i % 4)) for i in range(n)]
    out += [(None, None, None, None, None), (None, "hot", "de", 5, "a\nb"), (None, "hot", "de", 5, "a\nb"),
            (5, "é", "fr", 0, ""), (5, "é", "fr", 0, ""), (6, "lone", None, -3, "ü\n" * 50_000), (-4, "", "x", 1, "\n")]
    return out


@pytest.mark.parametrize("n", [0, 40, 300])
def test_equals_plain_trees(spark, n):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows(n)], SCHEMA + ", _rank int, tree string")
    assert found(mf.audit(docs, height=2)) == brute(rows(n))


def test_packs_of_full_height(spark):
    many = [(i, "a" if i < 2200 else "b", "en", i, f"t{i}\n") for i in range(2300)]
    docs = spark.createDataFrame(many, SCHEMA)
    assert found(mf.audit(docs.repartition(5))) == brute(many)


def test_one_leaf_and_no_leaves(spark):
    one = [(3, "a", "en", 1, "x\n")]
    got = found(mf.audit(spark.createDataFrame(one, SCHEMA)))
    assert got == brute(one) and got[0][1] == got[0][3]
    empty = mf.audit(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "verified" in empty.columns


def test_chosen_leaves_get_paths_that_fold_to_the_root(spark):
    many = rows(200)
    m = mf.manifest(spark.createDataFrame(many, SCHEMA))
    got = mf.proofs(m, chosen=F.col("_id") % 10 == 0).collect()
    assert len(got) == sum(r[0] is not None and r[0] % 10 == 0 for r in many)
    assert all(mf.folded(r.leaf, r.places, r.siblings) == m.root == r.folded_root for r in got)
    assert all(mf.folded("0" * 64, r.places, r.siblings) != m.root for r in got)


def test_large_group_tables_give_the_same(spark, monkeypatch):
    from foldmark.llm import order
    from foldmark.operators import lookup
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(order, "MAX_BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(rows(60), SCHEMA)
    assert found(mf.audit(docs)) == brute(rows(60))
