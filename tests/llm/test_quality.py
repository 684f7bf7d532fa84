import random
import re
from collections import Counter

from foldmark.llm import quality


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
            len(cover), len(lines))


def test_measures_equal_plain_code(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "a", "a b c a b c", "a a a a", "é🙂 #\n\n#\n#", "a\x0bb\x0cc d"] + [
        "".join(rng.choice(["ab ", "c ", "D\n", "#", "|", "é ", "\t", "!"]) for _ in range(rng.randint(0, 90)))
        for _ in range(200)] + ["w " * 30000 + " ".join(map(str, range(30000)))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judged(quality.ledger(docs)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "# " * 60), (3, None), (3, " ".join(map(str, range(90))))],
                                 "doc_id long, text string")
    rows = quality.ledger(docs)
    assert sorted(r.kept for r in quality.judged(rows).collect()) == [False, False, False, True]
    got = {r.rule: (r.fails, r.fails_alone) for r in quality.ablation(rows).collect()}
    assert got["few_words"] == (2, 2) and got["symbols"] == (1, 0) and got["repeated_words"] == (1, 0)
    kept = quality.keep_good(docs)
    assert kept.columns == ["doc_id", "text"] and kept.count() == 1
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.ablation(rows.limit(0)).count() == 0


def test_labelled_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    both = quality.judged(quality.ledger(docs)).join(labels, "doc_id").toPandas()
    good = both[(both.quality == 1) & ~both.base_failed]
    assert good.kept.mean() > 0.99 and both[both.quality == 0].kept.mean() < 0.2
