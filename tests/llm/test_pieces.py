import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from foldmark.llm import pieces
from foldmark.llm.pieces import Pieces

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(1)
    alphabet = "aabbcde  lltthhee<>&é漢字🙂\n\t▁  "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)] + [
        "", "a" * 5000, "ab" * 3000, " " * 700, "<s></s><unk><0x41>", "the" * 500, "▁▁ a", "\x00\x01"]


def test_ids_equal_the_library(library, folder):
    import pyarrow.parquet as pq

    p = Pieces(MODEL)
    texts = odd_texts() + pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()
    ids, starts = p.encode(pa.array(texts))
    for t, a, z in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:z].tolist() == library.encode(t), t[:60]
    back = p.decode(ids, starts)
    assert all(b.decode() == t.replace("▁", " ") for b, t in zip(back, texts))


def test_window_is_given_out_early():
    p = Pieces(MODEL)
    parts = list(p.stream("ab" * 3000))
    assert len(parts) > 20 and sum(parts, []) == sum(p.stream("ab" * 3000), [])


def test_arrays_follow_the_same_paths(monkeypatch):
    p, rng = Pieces(MODEL), random.Random(5)
    words = ["", "▁", "🙂", "▁🙂é漢"] + ["".join(rng.choice("▁aabcdehilnrstu\n&é漢🙂\x00") for _ in range(rng.randint(1, 64)))
                                      for _ in range(800)]
    ids, sizes = p.side_by_side(words)
    assert np.split(ids, np.cumsum(sizes))[-1].size == 0
    for w, got in zip(words, np.split(ids, np.cumsum(sizes))):
        assert got.tolist() == [i for part in p.stream(w) for i in part], w
    # stretches are forgotten and found anew
    texts = pa.array([" ".join(words[k:k + 9]) for k in range(0, 800, 9)] * 2)
    want, _ = p.encode(texts)
    monkeypatch.setattr(pieces, "STRETCHES", 5)
    assert all((p.encode(texts)[0] == want).all() for _ in range(2))


def test_edges_agree_with_merges():
    p, rng = Pieces(MODEL), random.Random(3)
    names = sorted(x for x in p.whole if x.isascii())
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        if a not in p.whole or b not in p.whole:
            continue
        assert p.compatible(a, b) == (p.merged(a + b) == [a, b]), (a, b)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (2, "", 7), (None, "é" * 9, 8)],
                                 "doc_id long, text string, ids int")
    got = pieces.encoded(docs, MODEL).toPandas()
    assert len(got) == 4 and got.round_trip.all()
    row = got[got.n_bytes == 11].iloc[0]
    assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes()) and row.n_tokens == len(row.ids)
    back = pieces.decoded(pieces.encoded(docs, MODEL), MODEL).toPandas()
    assert sorted(back.text) == ["", "", "hello world", "é" * 9]
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0
