"""Streams over the events table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded
from foldmark.plans.catalog.journal import _REPLAY
from foldmark.plans.catalog.sequences import HISTORY
from foldmark.streaming.journal_counts import windowed_counts
from foldmark.streaming.run import drain, drain_whole, source_table
from foldmark.streaming.stateful import (
    HISTORY as HISTORY_ROWS, closed_by_end, history_step, stream_history, stream_incumbent,
)


@query("s_journal_counts", f"""WITH {fx.JOURNAL}, c AS (
  SELECT run, event, time_bucket(INTERVAL 10 MINUTE, CAST(t AS TIMESTAMP)) AS w, count(*) AS n
  FROM journal GROUP BY ALL)
SELECT run, event, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n FROM c
WHERE w + INTERVAL 10 MINUTE <= (SELECT max(CAST(t AS TIMESTAMP)) FROM journal) - INTERVAL 1 HOUR""")
def s_journal_counts(spark, folder):
    """Windows closed by the watermark, one hour behind the latest event."""
    stream = windowed_counts(fx.journal_of(source_table(spark, folder, "events")))
    done = drain(stream, "journal-counts")
    return done.select("run", "event", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
                       .alias("window_start"), "n")


# The watermark stays this far behind the latest event; later rows are still open.
_DELAY = "INTERVAL 1 HOUR"


_VALID = "(event = 'RESULT' OR event = 'BASELINE') AND ok"


@query("s_incumbent", _REPLAY.replace("true AS accepted", "round(score, 6) AS score")
       .replace("SELECT run, iter, i, bar FROM", "SELECT run, iter, i, bar, score FROM")
       .replace("v.i, v.bar, row", "v.i, v.bar, v.score, row")
       .replace(f"{_VALID})", f"""{_VALID} AND CAST(t AS TIMESTAMP) <
    (SELECT max(CAST(t AS TIMESTAMP)) FROM journal WHERE {_VALID}) - {_DELAY})"""))
def s_incumbent(spark, folder):
    """Every result that became the incumbent, up to the watermark."""
    stream = stream_incumbent(fx.journal_of(source_table(spark, folder, "events")))
    return rounded(drain(stream, "incumbent"))


@query("s_since_last", f"""WITH {HISTORY} SELECT CAST(user_id AS VARCHAR) AS entity, event_id AS key,
  CAST(cum AS BIGINT) AS cum_count, since AS since_last FROM h""")
def s_since_last(spark, folder):
    """Running history of every event, also of those still open when the input ends."""
    hit = (F.col("event_type") == "purchase").cast("int")
    stream = stream_history(source_table(spark, folder, "events"), "user_id", "ts", "event_id", hit)
    return drain_whole(stream, "history", partial(closed_by_end, step=history_step, schema=HISTORY_ROWS))
