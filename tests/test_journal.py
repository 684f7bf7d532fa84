import json
import tempfile

import pytest
from pyspark.sql import functions as F

from foldmark.operators import journal as ops
from foldmark.operators import sequence
from foldmark.sources.journal import append_journal, read_journal
from foldmark.sources.tables import read_csv, read_texts, write_csv


@pytest.fixture()
def place():
    return tempfile.mkdtemp(prefix="foldmark-test-")


def write(place, lines):
    path = f"{place}/journal.jsonl"
    with open(path, "w") as f:
        f.write("\n".join(lines))
    return path


def test_blank_bad_and_nan_lines(spark, place):
    path = write(place, [json.dumps({"event": "BASELINE", "score": 0.5}), "", "{broken",
                         '{"event": "RESULT", "score": NaN, "ok": false}'])
    got = read_journal(spark, path).select("event", "score", "ok").collect()
    assert [tuple(r) for r in got] == [("BASELINE", 0.5, None), ("RESULT", None, False)]
    with pytest.raises(Exception):
        read_journal(spark, path, strict=True).collect()


def test_noise_is_dropped(spark, place):
    path = write(place, [json.dumps(e) for e in (
        {"event": "BASELINE", "score": 0.5}, {"event": "TOOL_CALL", "name": "x"},
        {"event": "RESULT", "score": 0.6})])
    kept = ops.without_noise(read_journal(spark, path))
    assert sorted(r["event"] for r in kept.collect()) == ["BASELINE", "RESULT"]


def test_append_keeps_runs_apart(spark, place):
    rows = spark.createDataFrame([("r1", "START"), ("r2", "DONE")], "run string, event string")
    path = f"{place}/runs"
    append_journal(rows, path, by_run=True)
    append_journal(rows, path, by_run=True)
    assert read_journal(spark, path).count() == 4
    assert read_journal(spark, f"{path}/run=r1").count() == 2


@pytest.mark.parametrize("model,tokens_in,tokens_out,want", [
    ("qwen3-235b-a22b-fp8", 1_000_000, 1_000_000, 1000.0),
    ("deepseek-v32", 1_000_000, 1_000_000, 1300.0),
    ("gpt-oss-20b", 1_000_000, 1_000_000, 200.0),
    ("yandexgpt", 1_000_000, 1_000_000, 2400.0),
    ("yandexgpt-5.1", 1_000_000, 1_000_000, 1600.0),
    ("Qwen3-235B-A22B-FP8", 250_000, 100_000, 175.0),
    ("gpt://folder/qwen3-235b-a22b-fp8/latest", 250_000, 100_000, 175.0),
    ("gpt://qwen3-235b-a22b-fp8", 250_000, 100_000, 175.0),
    (" deepseek-v32/rc", 0, 1_000_000, 800.0),
    ("qwen3-235b-a22b-fp8", 0, 0, 0.0), ("qwen3-235b-a22b-fp8", None, None, 0.0),
    ("unknown", 1000, 1000, None), (None, 1000, 1000, None), ("", 1, 1, None),
])
def test_cost(spark, model, tokens_in, tokens_out, want):
    usage = spark.createDataFrame([("TOKEN_USAGE", model, tokens_in, tokens_out)],
                                  "event string, model string, input long, output long")
    got = ops.usage_cost(usage).first()["cost"]
    assert got is None if want is None else got == pytest.approx(want)


def results(spark, rows):
    return spark.createDataFrame(
        [(run, event, f"2024-01-01 00:00:{i:02}", it, ok, score, std)
         for i, (run, event, it, ok, score, std) in enumerate(rows)],
        "run string, event string, t string, iter int, ok boolean, score double, std double")


RUN = [("a", "BASELINE", None, True, 0.50, 0.10), ("a", "RESULT", 0, True, 0.505, 0.1),
       ("a", "RESULT", 1, True, 0.52, 0.5), ("a", "RESULT", 2, False, 0.9, 0.1),
       ("a", "RESULT", 3, True, 0.56, 0.0), ("a", "RESULT", 4, True, 0.58, 0.0),
       ("a", "RESULT", 5, True, 0.58, 0.0), ("b", "RESULT", 0, True, 0.1, 0.0),
       ("b", "RESULT", 1, True, 0.2, 0.0), ("a", "RESULT", 6, True, None, None)]


def test_replay(spark):
    got = sorted((r["run"], r["iter"]) for r in ops.replay(results(spark, RUN)).collect())
    # 0 is inside the noise of the baseline, 3 inside the wide noise of 1
    assert got == [("a", 1), ("a", 4), ("b", 0), ("b", 1)]


def test_replay_downwards(spark):
    rows = [("a", "BASELINE", None, True, 2.0, 0.1), ("a", "RESULT", 0, True, 1.995, 0.1),
            ("a", "RESULT", 1, True, 1.9, 0.1), ("a", "RESULT", 2, True, 3.0, 0.1)]
    got = ops.replay(results(spark, rows), greater_is_better=False).collect()
    assert [(r["iter"], r["accepted"]) for r in got] == [(1, True)]


@pytest.mark.parametrize("rows_per_piece", [2_000_000, 20])
def test_replay_of_a_long_run(spark, monkeypatch, rows_per_piece):
    """Records found in pieces lead to the same accepts as a plain walk."""
    import numpy as np
    monkeypatch.setattr(sequence.running_max_before, "__defaults__", (rows_per_piece,))
    rng = np.random.default_rng(3)
    score = (np.cumsum(rng.normal(0, .01, 600)) + np.arange(600) * .001).round(4)
    std = rng.random(600).round(3) / 10
    rows = spark.createDataFrame(
        [("a", "RESULT", f"2024-01-01 {i // 60:02}:{i % 60:02}:00", i, True, float(s), float(d))
         for i, (s, d) in enumerate(zip(score, std))],
        "run string, event string, t string, iter int, ok boolean, score double, std double")
    want, bar = [], None
    for i, (s, d) in enumerate(zip(score, std)):
        if bar is None or s > bar:
            want.append(i)
            bar = s + 0.1 * max(d, 1e-9)
    got = sorted(r["iter"] for r in ops.replay(rows).collect())
    assert got == want


@pytest.mark.parametrize("text,want", [
    ("Target encoding of Driver", "target encoding, single column"),
    ("Target encoding of Driver × Race", "target encoding, interaction"),
    ("**Hypothesis**:", "empty"), ("", "empty"), (None, "empty"),
    ("sin/cos of the lap", "cyclic"), ("cumulative pit count", "history"),
    ("frequency encoding", "frequency encoding"), ("product of a and b", "numeric interactions"),
    ("something else", "other")])
def test_themes(spark, text, want):
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(ops.theme(F.col("m")).alias("t")).first()["t"] == want


def test_csv_and_texts(spark, place):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id int, s string, x double")
    back = read_csv(spark, write_csv(rows, f"{place}/csv"))
    assert sorted(map(tuple, back.collect())) == [(1, "a", 0.5), (2, None, None)]
    for name, text in (("b.txt", "second\nline"), ("a.txt", "first")):
        with open(f"{place}/{name}", "w") as f:
            f.write(text)
    assert read_texts(spark, [f"{place}/b.txt", f"{place}/a.txt"]) == "second\nline\n\nfirst"
