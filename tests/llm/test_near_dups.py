import random
import re

from foldmark.llm import near_dups
from foldmark.llm.near_dups import Likeness


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


def corpus(seed, bases=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ä", "é!", "THE"]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A  b\tc\nd", "a b c e"]
    hot = rng.choices(words, k=30)
    for b in range(bases):
        base = rng.choices(words, k=rng.choice([6, 20, 60, 70, 90, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy if rng.random() < .7 else copy + hot[:10]))
        if b % 4 == 0:
            texts.append(" ".join(base[:5] + hot))
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, like=Likeness(shingle=4)):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows],
                                 "doc_id long, text string, rep string").repartition(3)
    return near_dups.near_duplicates(docs, like).collect()


def test_equal_to_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, rows)}
        assert got == want


def test_rounds_give_the_same(spark, monkeypatch):
    """A chain of edits: the pivot is alike only to some of its list."""
    rng = random.Random(5)
    text, rows = [f"w{i}" for i in range(120)], []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[(i * 7) % 120] = f"e{rng.random()}"
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert {r.doc_id: r.component_id for r in result(spark, rows)} == want
    monkeypatch.setattr(near_dups, "PIVOT_ROUNDS", 1)
    assert {r.doc_id: r.component_id for r in result(spark, rows)} == want


def test_deeper_lists_give_the_same(spark, monkeypatch):
    """All that pivots leave goes to deeper sketches, of whole sets and of parts."""
    monkeypatch.setattr(near_dups, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(near_dups, "FEW", 0)
    rows = corpus(3)
    want = {i: c for i, (_, c) in brute(rows).items()}
    for deep in (512, 64):
        monkeypatch.setattr(near_dups, "DEEP", deep)
        assert {r.doc_id: r.component_id for r in result(spark, rows)} == want


def copies_of_one(n, seed=8):
    """Edited copies of one text, most of which are linked with few others, and a shared passage."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([2, 5, 9, 14])):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        rows.append((i, " ".join(copy)))
    for i in range(n, 2 * n):
        rows.append((i, " ".join(base[:60] + [f"u{i}-{j}" for j in range(rng.choice([4, 10, 25, 80]))])))
    rng.shuffle(rows)
    return rows


def test_many_copies_and_a_passage(spark):
    rows = copies_of_one(120)
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert {r.doc_id: r.component_id for r in result(spark, rows)} == want


def test_candidates_grow_with_the_group(spark, monkeypatch):
    """Without earlier rounds, a group of edited copies gives no pairs of all its members."""
    monkeypatch.setattr(near_dups, "PIVOT_ROUNDS", 0)
    made = []
    linked = near_dups.linked

    def counted(pairs, *more):
        made.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(near_dups, "linked", counted)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(700)], []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(700), rng.choice([3, 8, 12, 30, 40])):
            copy[at] = f"e{rng.random()}"
        rows.append((i, " ".join(copy)))
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in result(spark, rows)} == want
    assert sum(made) <= 5 * len(rows)  # of 11,175 pairs


def test_large_classes_travel_to_their_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT_LEAST", 3)
    monkeypatch.setattr(near_dups, "HOT_SHARE", 10)
    rows = [(i, "a b c d e f") for i in range(9, 0, -1)] + [(20, "a b c d e f g h"), (21, None), (22, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, rows)}
    assert got == {**{i: (3, 1) for i in range(1, 10)}, 20: (5, 20), 21: (0, 21), 22: (0, 22)}


def test_no_rows_nulls_and_repeats(spark):
    assert result(spark, []) == []
    rows = [(None, "x y z w v"), (None, ""), (4, "x y z w v"), (4, "x y z w v"), (9, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in result(spark, rows))
    assert got == [(-1, 0, None, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True),
                   (9, 0, 9, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dups.one_of_each(docs, Likeness(shingle=4)).count() == 3


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    got = {r.doc_id: r.component_id for r in result(spark, [(1, long), (2, long + " end"), (3, "a b")])}
    assert got == {1: 1, 2: 1, 3: 3}


def test_rows_without_an_id_stay_apart(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"] + " end"), (1, text["a"] + " end"),
            (2, text["c"]), (7, text["d"]), (7, text["c"] + " end"), (7, text["e"]), (None, text["f"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    like = Likeness(shingle=4)
    got = sorted((r.doc_id or 0, r.text) for r in near_dups.one_of_each(docs, like).collect())
    free = [r for r in got if r[1].startswith("b")]
    assert len(free) == 1 and free[0][0] == 0
    assert [r for r in got if r not in free] == sorted(
        (i or 0, t) for i, t in (rows[3], rows[4], rows[5], rows[7], rows[8]))
    named = {(r.doc_id, r.component_id) for r in result(spark, rows)}
    assert named == {(None, 1), (None, None), (1, 1), (2, 2), (7, 7), (7, 2)}


def test_columns_named_like_our_own_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 10, "k"), (2, "a b c d e f", 20, None), (3, None, 30, "x")],
                                 "doc_id long, text string, _row long, _doc string")
    got = near_dups.one_of_each(docs, Likeness(shingle=4))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 10, "k"), (3, None, 30, "x")]
