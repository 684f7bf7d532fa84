import tempfile

from foldmark.sources import journal


def test_lines_are_written_once_and_not_cached(spark):
    place, path = (tempfile.mkdtemp(prefix="foldmark-test-") + "/x" for _ in range(2))
    lines = ['{"event": "RESULT", "score": NaN, "iter": 3}', "", "  ", '{"event": "DONE"', '{"score": 1}', "[1]",
             '{"event": "START", "folds": [0.5, 0.25]}']
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    rows, bad = journal.follow_journal(spark, path, place)
    got = sorted((r["event"], r["iter"], r["score"], r["folds"]) for r in rows.collect())
    assert got == [("RESULT", 3, None, None), ("START", None, None, [0.5, 0.25])]
    assert sorted(r["value"] for r in bad.collect()) == ["[1]", '{"event": "DONE"', '{"score": 1}']
    assert spark.read.parquet(f"{place}/lines").count() == 5
    assert rows.columns == [c.split()[0] for c in journal.JOURNAL_SCHEMA.split(", ")] and bad.columns == ["value"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
