"""Streams of several micro-batches give what the batch operators give."""

import tempfile

import pytest
from pyspark.sql import functions as F

from foldmark.operators import journal as ops
from foldmark.operators.sequence import event_history
from foldmark.plans import fixtures as fx
from foldmark.streaming.journal_counts import windowed_counts
from foldmark.streaming.run import drain, drain_counted
from foldmark.streaming.stateful import stream_history, stream_incumbent


@pytest.fixture(scope="module")
def batches(spark, folder):
    """The events in four files that follow each other in time."""
    base = tempfile.mkdtemp(prefix="foldmark-test-")
    events = spark.read.parquet(f"{folder}/events.parquet")
    cuts = events.select(F.percentile("event_id", F.array(*[F.lit(p) for p in (.25, .5, .75)]))).first()[0]
    edges = [-1, *cuts, 10 ** 12]
    import os
    import time
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        (events.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1)
         .write.mode("append").parquet(f"{base}/part{i}"))
        for name in os.listdir(f"{base}/part{i}"):
            os.utime(f"{base}/part{i}/{name}", (time.time() - 100 + i * 10,) * 2)
    return base, events


def stream(spark, batches):
    base, events = batches
    return (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{base}/part*"))


def closed(df, at, delay):
    """The rows that the watermark has passed."""
    last = df.agg(F.max(at)).first()[0]
    return df.filter(at < F.lit(last) - F.expr(f"interval {delay}"))


def shuffled(spark, batches, order, delay):
    """The same files, oldest last or in any other order, and a stream of them."""
    import os
    import time
    base, events = batches
    place = tempfile.mkdtemp(prefix="foldmark-test-")
    for i, part in enumerate(order):
        spark.read.parquet(f"{base}/part{part}").coalesce(1).write.parquet(f"{place}/f{i}")
        for name in os.listdir(f"{place}/f{i}"):
            os.utime(f"{place}/f{i}/{name}", (time.time() - 100 + i * 10,) * 2)
    return (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{place}/f*"))


def hits():
    return (F.col("event_type") == "purchase").cast("int")


@pytest.mark.parametrize("order,delay", [((0, 1, 2, 3), "1 hour"), ((3, 1, 0, 2), "100 days"),
                                         ((2, 3, 1, 0), "100 days")])
def test_history_does_not_depend_on_the_order_of_files(spark, batches, order, delay):
    # a last event far ahead closes all others
    events = batches[1]
    ahead = events.limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 3000 days"),
                                         "event_id": F.lit(10 ** 9).cast("bigint"),
                                         "user_id": F.lit(-5).cast(events.schema["user_id"].dataType)})
    base = tempfile.mkdtemp(prefix="foldmark-test-")
    for i in range(4):
        spark.read.parquet(f"{batches[0]}/part{i}").coalesce(1).write.parquet(f"{base}/part{i}")
    ahead.write.parquet(f"{base}/part4")
    stream = shuffled(spark, (base, events), (*order, 4), delay)
    out, late = drain_counted(stream_history(stream, "user_id", "ts", "event_id", hits(), delay), "test-history")
    want = event_history(events, ["user_id"], "ts", "event_id", hits() == 1)
    got = sorted(map(tuple, out.select("key", "cum_count", "since_last").collect()))
    assert got == sorted(map(tuple, want.select("event_id", "cum_count", "since_last").collect()))
    assert len(got) == events.count() and late == 0


def test_late_rows_are_dropped_and_counted(spark, batches):
    events = batches[1]
    stream = shuffled(spark, batches, (1, 2, 0, 3), "1 hour")
    out, late = drain_counted(stream_history(stream, "user_id", "ts", "event_id", hits(), "1 hour"), "test-late")
    first = spark.read.parquet(f"{batches[0]}/part0").count()
    assert 0 < late <= first + 50
    assert out.count() + late <= events.count()


def test_a_silent_entity_is_forgotten(spark):
    import os
    import time
    base = tempfile.mkdtemp(prefix="foldmark-test-")
    days = [(0, 1, True), (1, 1, False), (2, 2, False), (40, 2, False), (60, 2, False), (61, 1, False), (99, 2, True),
            (160, 3, True)]
    for i, (day, user, hit) in enumerate(days):
        (spark.createDataFrame([(i, user, hit, day)], "event_id long, user_id long, hit boolean, day int")
         .withColumn("ts", F.timestamp_seconds((F.col("day") + 9000) * 86400)).coalesce(1).write.parquet(f"{base}/f{i}"))
        for name in os.listdir(f"{base}/f{i}"):
            os.utime(f"{base}/f{i}/{name}", (time.time() - 100 + i * 10,) * 2)
    schema = spark.read.parquet(f"{base}/f0").schema

    def run(expire):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/f*")
        got = drain(stream_history(s, "user_id", "ts", "event_id", "hit", "1 hour", expire), "test-expire")
        return {r["key"]: (r["cum_count"], r["since_last"]) for r in got.collect()}

    assert run(None)[5] == (1, 2)
    assert run("10 days")[5] == (0, 0) and run("10 days")[1] == (1, 1)


def test_incumbent_in_any_order(spark, batches):
    journal = fx.journal_of(batches[1])
    at = F.to_timestamp("t")
    delay = "100 days"
    out = drain(stream_incumbent(fx.journal_of(shuffled(spark, batches, (2, 0, 3, 1), delay)), delay=delay), "test-any")
    order = drain(stream_incumbent(fx.journal_of(stream(spark, batches))), "test-incumbent")
    for got, wait in ((out, delay), (order, "1 hour")):
        want = ops.replay(closed(journal, at, wait)).collect()
        assert sorted((r["run"], r["iter"]) for r in got.collect()) == \
            sorted((r["run"], r["iter"]) for r in want)


def test_counts_over_batches(spark, batches):
    out = drain(windowed_counts(fx.journal_of(stream(spark, batches))), "test-counts").collect()
    table = windowed_counts(fx.journal_of(batches[1]))
    last = fx.journal_of(batches[1]).agg(F.max(F.to_timestamp("t"))).first()[0]
    closed = table.filter(F.col("window_end") <= F.lit(last) - F.expr("interval 1 hour")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, closed))
    assert len(closed) > 0
