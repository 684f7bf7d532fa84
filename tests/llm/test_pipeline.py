"""The stages against plain code, each on what the one before kept."""

import numpy as np
import zlib

import corpus_pipeline
import test_near_dups
import test_repeats
from foldmark.llm import mixing, quality


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    good = {r.doc_id for r in quality.judged(quality.ledger(docs)).filter("kept").collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == names and {i for i, _ in rows} == good

    near = corpus_pipeline.near_dedup(spark, kept, folder)
    near.write.parquet(str(tmp_path / "near"))
    near = spark.read.parquet(str(tmp_path / "near"))
    want = {i for i, (_, c) in test_near_dups.brute(rows, size=5).items() if i == c}
    rows = [r for r in rows if r[0] in want]
    assert near.columns == names and {r.doc_id for r in near.collect()} == want

    cut = corpus_pipeline.suffix_array_dedup(spark, near, folder)
    assert cut.columns == names
    lost = {i: (n, gone) for i, n, gone, _, _ in test_repeats.brute(rows, 50)}
    for r in cut.collect():
        n, gone = lost[r.doc_id]
        assert n - gone - 6 * (gone > 0) * 20 <= len(r.text.encode()) <= n - gone
        assert r.n_chars == len(r.text)

    cut.write.parquet(str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    mixed = corpus_pipeline.source_mixing(spark, cut, folder)
    ids = sorted(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and set(ids) <= want
    # ids are unique here: each is there once per pass that reads it
    assert ids == sorted(r.doc_id for r in mixing.mixed(cut).collect())

    out = corpus_pipeline.sentencepiece(spark, mixed, folder).collect()
    assert sorted(r.doc_id for r in out) == ids and all(r.round_trip for r in out)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
