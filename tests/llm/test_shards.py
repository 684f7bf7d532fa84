import random

import pytest
from pyspark.sql import functions as F

from foldmark.llm import shards
from foldmark.llm.shards import cuts_of


def greedy(ends, capacity, k):
    total, at, cuts = ends[-1], 0, []
    for _ in range(k):
        if at + capacity >= total:
            return cuts + [total]
        at = max([e for e in ends if e <= at + capacity], default=0)
        cuts.append(at)
    return cuts if at >= total else None


@pytest.mark.parametrize("n,k,cells", [(300, 24, 64), (40, 5, 8), (7, 24, 4), (1, 3, 4)])
def test_cuts_equal_plain_search(spark, n, k, cells):
    rng = random.Random(n)
    sizes = [rng.choice([1, 8, 9, 300, 5000]) + rng.randint(0, 50) for _ in range(n)]
    ends = [sum(sizes[:i + 1]) for i in range(n)]
    want = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(ends, c, k))
    got, cuts = cuts_of(spark.createDataFrame([(e,) for e in ends], "end long"),
                        ends[-1], max(sizes), k, cells)
    assert got == want
    assert cuts == greedy(ends, want, k)


def test_rows_keep_together_and_slots_are_gapless(spark):
    rows = [(i, t, "x") for i, t in enumerate(
        ["a" * 40, None, "", "b", "é" * 9, "a" * 40, "c" * 500, "a" * 40] * 4)]
    rows += [(None, "z", "x"), (3, "b", "x"), (3, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shards.by_bytes(docs, 5).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    assert got[got.doc_id == 4]["size"].iloc[0] == 18 + 8
    assert got.law.unique().tolist() == ["bytes"] and got.grown_shard.isna().all()


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shards.by_bytes(docs, 24).count() == 0


def test_whole_table_is_balanced(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = shards.by_bytes(docs, 24)
    sums = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert sum(sums) == docs.agg(F.sum(F.octet_length("text") + 8)).first()[0]
    assert got.count() == docs.count() and len(sums) <= 24
