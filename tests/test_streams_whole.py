"""A stream over a finite table gives every row, also the last ones."""

import tempfile

from pyspark.sql import functions as F

from foldmark.operators.sequence import event_history
from foldmark.plans.catalog.streams import s_since_last


def written(spark, rows):
    place = tempfile.mkdtemp(prefix="foldmark-test-")
    made = (spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string")
            .select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type"))
    made.coalesce(1).write.parquet(f"{place}/made")
    import os
    name = next(n for n in os.listdir(f"{place}/made") if n.endswith(".parquet"))
    os.link(f"{place}/made/{name}", f"{place}/events.parquet")
    return place, made


def test_rows_of_the_last_delay_are_there(spark):
    """Users of one and of many rows; the last hour, and nulls."""
    rows = [(2 ** 60 + i, 1_700_000_000 + 37 * (i * 7 % 900), i * i % 13 if i % 9 else i,
             "purchase" if i % 5 == 0 else None if i % 7 == 0 else "view") for i in range(900)]
    rows += [(5, None, 3, "purchase"), (6, None, 3, "view"), (7, 1_700_000_100, None, "purchase"),
             (8, 1_700_000_200, None, "view"), (None, 1_700_000_200, None, "view")]
    place, made = written(spark, rows)
    got = s_since_last(spark, place)
    # nulls of the order come last, as in the SQL
    last = made.withColumns({"ts": F.coalesce("ts", F.timestamp_seconds(F.lit(4_000_000_000))),
                             "event_id": F.coalesce("event_id", F.lit(2 ** 62))})
    want = event_history(last, ["user_id"], "ts", "event_id", F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string"), F.nullif("event_id", F.lit(2 ** 62)), "cum_count", "since_last")
    assert got.count() == len(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
