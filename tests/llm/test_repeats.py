import hashlib
import os
import random

import pyarrow as pa
import pytest

from foldmark.llm import repeats


def brute(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < i:
                gone[p:p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = [None, "", "short", "a" * 400, "b" + "a" * 90, "ab" * 100, "x" * 49, "x" * 50, "x" * 50]
    for _ in range(60):
        body = text(rng.randint(3, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(body))
            body = body[:at] + p[a:a + rng.randint(20, 200)] + body[at:]
        rows.append(body)
    rows += [rows[12], rows[13], rows[14] + "!"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows, width=50):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows],
                                 "doc_id long, text string, hash string").repartition(3)
    return sorted(tuple(r) for r in repeats.removal_counts(docs, width=width).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_every_string(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows, 50)


def test_phrases_cover_every_string_once():
    import numpy as np
    import pyarrow as pa

    texts = pa.array([t for _, t in corpus(3)])
    p = repeats.Phrases(texts)
    at, _ = p.strings(np.ones(len(p.start), bool))
    want = [s + k for s, e in zip(p.starts[:-1], p.starts[1:]) for k in range(max(0, e - s - 49))]
    assert at.tolist() == want


def test_hot_triggers_are_dealt_out():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    shared = "the one passage that every document holds, word for word and byte for byte"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(200)) + shared
             + "".join(rng.choice("abcdefgh ") for _ in range(200))) for i in range(120)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["_id", "_text"])
    found = list(repeats.phrase_entries([batch], 50, 50))
    loads = [len(r[3]) // 8 for r in found if r[0] >= 0]
    assert any(r[1] == 2 for r in found) and max(loads) < 12 * np.median(loads)


def test_no_rows_null_ids_and_repeated_ids(spark):
    assert result(spark, []) == []
    t = "z" * 30 + "0123456789" * 5
    got = sorted((r[0] or 0, r[2]) for r in [
        tuple(x) for x in repeats.removal_counts(spark.createDataFrame(
            [(None, t), (5, t), (5, t), (7, None)], "doc_id long, text string")).collect()])
    assert got == [(0, 0), (5, 80), (5, 80), (7, 0)]


def test_texts_keep_their_other_columns(spark):
    p = "é" * 60
    docs = spark.createDataFrame([(1, "a " + p, 0, "s"), (2, p + " b", 0, None), (3, None, 9, "t")],
                                 "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert got[1].text == "a " + p and got[2].text == " b" and got[2].n_chars == 2
    assert got[3].text == "" and got[3].source == "t" and got[2].source is None


def test_small_flushes(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for flush in (1, 7, 300):
        got = sorted(tuple(r) for r in repeats.removal_counts(docs, flush=flush).collect())
        assert got == brute(rows, 50)


def test_entries_of_runs_with_other_borders(spark, tmp_path):
    """Every run of the entries has borders of its own, as tasks have after a shuffle."""
    text = "".join(random.Random(6).choices("abcdefgh ", k=200))
    seen = str(tmp_path / "run")

    def entries(batches):
        try:
            os.close(os.open(seen, os.O_CREAT | os.O_EXCL))
            begin = 0
        except FileExistsError:
            begin = 1
        table = pa.Table.from_batches(list(batches)).sort_by("_id")
        cuts = [0, *range(2 - begin, table.num_rows, 2), table.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            flush = table.slice(a, z - a).combine_chunks().to_batches()
            yield from repeats.frames(repeats.phrase_entries(flush, 3, 50), repeats.ENTRIES)

    docs = spark.createDataFrame([(i, text) for i in range(24)], "_id long, _text string")
    made = docs.repartition(1).mapInArrow(entries, repeats.ENTRIES)
    found = repeats.decisions(made, repeats.met_phrases).collect()
    assert {r._id for r in found if r.kind == repeats.WHOLE} == set(range(1, 24))
