"""Intermediate tables go as soon as nothing reads them; work is done once."""

import os

from public_tokenizers import path

from foldmark.llm import near_dups, token_files
from foldmark.llm.near_dups import Likeness
from foldmark.session import checkpoint_dir

TEXT = " ".join(f"w{i}" for i in range(90))
ROWS = [(1, TEXT), (2, TEXT + " end"), (3, TEXT), (4, "a b c d e f"), (5, None)]


def tables(spark):
    return set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))


def test_near_dedup_leaves_only_what_is_read(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    checkpoint_dir(spark)
    before = tables(spark)
    kept = near_dups.one_of_each(docs, Likeness(shingle=4))
    assert sorted(f[:4] for f in tables(spark) - before) == ["kept", "numb"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    before = tables(spark)
    found = near_dups.near_duplicates(docs, Likeness(shingle=4))
    assert sorted(f[:4] for f in tables(spark) - before) == ["labe", "numb", "sket"]
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_pairs_are_taken_apart_once(spark, monkeypatch):
    names, plain = [], near_dups.written
    monkeypatch.setattr(near_dups, "written", lambda df, name: names.append(name) or plain(df, name))
    near_dups.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string"), Likeness(shingle=4))
    assert names.count("needed") == names.count("found") > 0


def test_one_python_worker_tokenises_and_packs(spark, tmp_path, monkeypatch):
    calls, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), path("word_bpe_49k.json"))
    assert len(calls) == 1 and spark.read.parquet(str(tmp_path / "t")).count() > 0
