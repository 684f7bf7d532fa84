import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from foldmark.llm import token_files as tf

TOKENIZER = path("word_bpe_49k.json")


@pytest.mark.parametrize("sizes", [[0], [1], [5, 3000, 2999, 1, 0], [1100] * 7])
def test_blocks_come_back(sizes):
    rng = np.random.default_rng(1)
    blocks = [np.where(rng.random(n) < .5, rng.integers(0, 9, n), rng.integers(0, 49408, n)) for n in sizes]
    blocks += [np.full(2500, 49407), np.tile([1, 2, 3], 900)]
    records = tf.encode_blocks(blocks, 49408)
    assert all((a == b).all() for a, b in zip(blocks, tf.decode_blocks(records)))
    assert len(records[-1]) < 700  # repeated contexts cost little
    alone = tf.encode_blocks(blocks[:1], 49408)
    assert alone[0] == records[0] and (tf.decode_blocks(records[:1])[0] == blocks[0]).all()


def test_damage_is_found():
    record = tf.encode_blocks([np.arange(500)], 49408)[0]
    for at in (0, 5, 9, len(record) // 2):
        bad = bytearray(record)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            tf.decode_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        tf.decode_blocks([record[:-2]])


def test_ids_equal_the_library(folder):
    import pyarrow.parquet as pq

    t = tf.WordTokenizer(TOKENIZER)
    rng = random.Random(2)
    texts = pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist() + [
        "", " \t\n", "<|endoftext|>a", "ΑΣ ß x y", "é ́ x", "don't it's", "🙂🙂漢"] + [
        "".join(rng.choice("aB '\n\t.,!éΣ́漢🙂0 <|>") for _ in range(80)) for _ in range(300)]
    ids, starts = t.encode(pa.array([*texts, None]), 1)
    for x, a, z in zip([*texts, ""], starts[:-1], starts[1:]):
        assert ids[a:z].tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids + [1], repr(x)


def test_report(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "doc_id")
    docs = docs.toDF("doc_id", "text", "ids").repartition(5)
    got = sorted(tf.token_report(docs, TOKENIZER).collect())
    t, at = tf.WordTokenizer(TOKENIZER).tokenizer, 0
    for row, (i, text) in zip(got, sorted((r.doc_id, r.text) for r in docs.collect())):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(row) == (i, at, len(ids), crc)
        at += len(ids)
    assert len(got) == docs.count()


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (3, None), (3, ""), (3, "b c"), (9, "z")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in tf.token_report(docs, TOKENIZER).collect())
    assert [g[2] for g in got] == [None, 3, 3, 3, 9] and sum(g[1] for g in got) == 5 + 1 + 2 + 1
    assert [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()]
    assert tf.token_report(docs.limit(0), TOKENIZER).count() == 0


def test_lanes_come_back():
    rng = np.random.default_rng(3)
    for n in (1023, 1024, 1025, 1535, 3 * 512 + 511, 40_000):
        block = np.where(rng.random(n) < .6, np.arange(n) % 97, rng.integers(0, 49408, n))
        record = tf.encode_blocks([block], 49408)[0]
        assert (tf.decode_blocks([record])[0] == block).all()
    for at in range(4, len(record), 997):
        bad = bytearray(record)
        bad[at] ^= 32
        with pytest.raises(ValueError):
            tf.decode_blocks([bytes(bad)])


def test_coding_is_array_work():
    # beside sorting as many numbers, so that a slow machine does not matter: 54 before
    def least(work, tries):
        took = []
        for _ in range(tries):
            t = time.process_time()
            result = work()
            took.append(time.process_time() - t)
        return min(took), result

    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 1_000_000), 49407)
    noise = rng.integers(0, 2 ** 62, len(ids))
    sort, _ = least(lambda: np.sort(noise, kind="mergesort"), 5)
    coding, back = least(lambda: tf.decode_blocks(tf.encode_blocks(tf.evenly(ids), 49408)), 2)
    assert (np.concatenate(back) == ids).all()
    assert coding < 30 * sort


def test_words_are_taken_apart():
    t = tf.WordTokenizer(TOKENIZER)
    texts = ["Word word, word. (word) WORD! été Été, ÉTÉ", "word42 it's ''s x'sa 'Re", "÷× ªº µ <|ENDOFTEXT|> a<|endoftext|>b <3",
             "a\x1cb c\x85d\xa0e  f Ét é, ≠ Σας ΣΑΣ ß ÿ,Ÿ", "'", "", "word"]
    ids, starts = t.encode(pa.array(texts), 1)
    for x, a, z in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:z].tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids + [1], repr(x)
    few = tf.WordTokenizer(TOKENIZER)
    few.encode(pa.array(texts[:1]), 1)
    assert sorted(few.known) == ["!", "(", ")", ",", ".", "word", "été"]


def test_words_over_the_limit(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 6)
    t = tf.WordTokenizer(TOKENIZER)
    for text in ("one two three", "four five two", "one two three four five six seven eight", "two nine"):
        ids, _ = t.encode(pa.array([text]), 1)
        assert ids.tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_other_rules_leave_words_whole(tmp_path):
    import json

    rules = json.loads(open(TOKENIZER, encoding="utf-8").read())
    rules["normalizer"]["normalizers"].pop()  # case is kept
    (tmp_path / "cased.json").write_text(json.dumps(rules), encoding="utf-8")
    t = tf.WordTokenizer(str(tmp_path / "cased.json"))
    text = "Word word, WORD! été ÉTÉ x'S <|endoftext|> a1"
    ids, _ = t.encode(pa.array([text, "", None]), 1)
    assert not t.plain and "word," in t.known
    assert ids.tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids + [1, 1, 1]


def test_a_long_text_spans_blocks(monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 3000)
    t = tf.WordTokenizer(TOKENIZER)
    rng = random.Random(5)
    text = " ".join(rng.choice(["word,", "Été", "x1", "don't"]) for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text, "end"])], ["_id", "_text"])
    rows = list(tf.packed_rows(tf.token_ids([batch], t, 1), 0, 49408))
    blocks = rows[0].column("blocks")[0].as_py()
    ids = [i for x in (text, "end") for i in t.tokenizer.encode(x, add_special_tokens=False).ids + [1]]
    assert len(rows) == 1 and len(blocks) == -(-len(ids) // 3000) > 3
    assert np.concatenate(tf.decode_blocks(blocks)).tolist() == ids
