import random

from pyspark.sql import functions as F

from foldmark.operators import ranks
from foldmark.operators.ranks import in_ranges, with_counts


def test_few_values_are_counted_and_looked_up(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 3, rng.choice([None, 1.5, -2.0, float(i % 40)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g int, x double")
    found = []
    for limit in (200_000, 10):         # looked up, and cut into ranges
        monkeypatch.setattr(ranks, "MAX_BROADCAST_ROWS", limit)
        table = with_counts(df, "x", ["g"])
        found.append(sorted(map(tuple, table.select("id", "g", "x", "less", "ties").collect())))
    assert found[0] == found[1]
    for i, g, x, less, ties in found[0]:
        own = [v for _, h, v in rows if h == g and v is not None]
        assert less == sum(v < x for v in own) and ties == own.count(x)
    assert len(found[0]) == sum(v is not None for _, _, v in rows)


def test_pieces_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_PIECE", 100)
    cut = in_ranges(spark.range(5000), ["id"], 5000)
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert len(sizes) >= 45 and max(sizes) < 400
    monkeypatch.setattr(ranks, "MAX_BROADCAST_ROWS", 10)
    got = {r["id"]: r["less"] for r in with_counts(spark.range(5000).withColumn("x", F.col("id") % 700), "x", [])
           .select("id", "less").collect()}
    counts = [len(range(v, 5000, 700)) for v in range(700)]
    assert all(got[i] == sum(counts[:i % 700]) for i in range(5000))
