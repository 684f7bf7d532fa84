"""Per-run and per-entity state in event time: the incumbent, the running history.

Rows may come in any order within ``delay``.  They are kept in state until the
watermark, the latest time seen less the delay, has passed them; only then are
they applied, in order of time and key, so the result does not depend on how
rows were dealt to files and batches.  A timer at the earliest row kept brings
them back when nothing new comes.  Rows that arrive behind the watermark are
dropped by the engine, which counts them (``drain_counted``).

Groups are dealt to buckets by hash, and a bucket's groups are advanced side by
side in arrays: a call of Python for every group would cost more than its rows.
A bucket's state holds the memory of its groups and the rows of one delay.

With ``expire``, a group that has been silent for that long in event time is
forgotten, and starts anew should it return.

Rows without a time come after all others: they are open until the input ends.
What is open then can be closed from the state left (``closed_by_end``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldmark.constants import JOURNAL_TIME_FORMAT, MIN_IMPROVEMENT_SIGMAS, SIGMA_FLOOR

BUCKETS = 128
STATE = "open binary, memory binary"

# From the next rows, in order of their group, time and key, and the memory of
# the groups, whose places the column ``group`` gives, to the rows to emit.  The
# memory is a pair of numbers, a and b, missing at first, and renewed in place.
Step = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def unpacked_state(opened: bytes | None, memory: bytes | None) -> tuple[list[pd.DataFrame], pd.DataFrame]:
    """The open rows of a bucket, if any, and the memory of its groups."""
    return ([] if opened is None else [unpacked(opened)],
            pd.DataFrame({"entity": pd.Series(dtype=object), "a": 0.0, "b": 0.0, "latest": 0.0})
            if memory is None else unpacked(memory))


def advanced(rows: pd.DataFrame, memory: pd.DataFrame, step: Step) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The memory after the rows, with their groups in it, and what they emit."""
    code, names = pd.factorize(pd.concat([memory["entity"], rows["entity"]], ignore_index=True).astype(object),
                               use_na_sentinel=False)
    grown = memory.drop(columns="entity").reindex(range(len(names)))
    grown.insert(0, "entity", names)
    rows = rows.assign(group=code[len(memory):]).sort_values(
        ["group", "us", "keyless", "key"], ignore_index=True)
    out = step(rows, grown)
    latest = rows.groupby("group")["us"].max()
    grown.loc[latest.index, "latest"] = latest.astype(float)
    return grown, out


def in_event_time(rows: DataFrame, step: Step, schema: str, delay: str,
                  expire: str | None = None) -> DataFrame:
    """Apply ``step`` to each group's rows in order of ``at`` and ``key``.

    ``rows`` has ``entity``, ``at`` (a timestamp), ``key`` and what the step
    needs.  A missing key comes last.
    """
    kept = None if expire is None else milliseconds(expire)

    def apply(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory = unpacked_state(*(state.get if state.exists else (None, None)))
        if not state.hasTimedOut:
            held += [d.drop(columns=["at", "bucket"]) for d in batches if len(d)]
        mark = state.getCurrentWatermarkMs()
        rest, out = None, None
        if held:
            rows = pd.concat(held, ignore_index=True)
            due = rows["us"] < mark * 1000
            ready, rest = rows[due], rows[~due]
            if len(ready):
                memory, out = advanced(ready, memory, step)
        waiting = rest is not None and len(rest) > 0
        timers = [-(-rest["us"].min() // 1000)] if waiting and rest["us"].notna().any() else []
        if kept is not None:
            silent = memory["latest"] // 1000 + kept < mark
            if waiting:
                silent &= ~memory["entity"].isin(rest["entity"])
            memory = memory[~silent].reset_index(drop=True)
            if len(memory):
                timers.append(memory["latest"].min() // 1000 + kept)
        if waiting or len(memory):
            state.update((packed(rest) if waiting else None, packed(memory) if len(memory) else None))
            if timers:
                state.setTimeoutTimestamp(max(int(min(timers)), mark + 1))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    timed = (rows.withColumns({"keyless": F.col("key").isNull(), "key": F.coalesce("key", F.lit(0)),
                               "bucket": F.pmod(F.xxhash64("entity"), F.lit(BUCKETS)).cast("int")})
             .withWatermark("at", delay).withColumn("us", F.unix_micros("at")))
    return timed.groupBy("bucket").applyInPandasWithState(
        apply, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def closed_by_end(spark: SparkSession, progress: str, step: Step, schema: str) -> DataFrame:
    """What the rows give that a stream left open when its input ended, from
    the state below its checkpoint; rows without a time are the last."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for opened, memory in zip(d["open"], d["memory"]):
                held, memory = unpacked_state(opened, memory)
                if held:
                    yield advanced(held[0], memory, step)[1]

    state = spark.read.format("statestore").load(progress).select("value.groupState.*")
    return state.filter(F.col("open").isNotNull()).mapInPandas(made, schema)


def stream_incumbent(journal: DataFrame, greater_is_better: bool = True,
                     sigmas: float = MIN_IMPROVEMENT_SIGMAS, delay: str = "1 hour",
                     expire: str | None = None) -> DataFrame:
    """Emit a row for every result that becomes the incumbent of its run."""
    sign = 1.0 if greater_is_better else -1.0
    valid = (journal.filter(F.col("event").isin("BASELINE", "RESULT"))
             .filter(F.coalesce(F.col("ok"), F.lit(False)) & F.col("score").isNotNull())
             .select(F.col("run").alias("entity"),
                     F.coalesce("iter", F.lit(-1)).cast("bigint").alias("key"),
                     F.to_timestamp("t", JOURNAL_TIME_FORMAT).alias("at"),
                     (F.col("score") * sign).alias("value"), "std",
                     (F.col("event") == "BASELINE").alias("is_baseline"))
             # such rows cannot be placed
             .filter(F.col("at").isNotNull() & F.col("entity").isNotNull()))

    def step(rows, memory):
        # a is the bar, b tells whether there is one
        bars, known = memory["a"].tolist(), memory["b"].notna().tolist()
        taken = []
        for r in rows.itertuples():
            if not known[r.group] or r.value > bars[r.group]:
                noise = 0.0 if pd.isna(r.std) else r.std
                bars[r.group], known[r.group] = r.value + sigmas * max(noise, SIGMA_FLOOR), True
                if not r.is_baseline:
                    taken.append((r.entity, r.key, sign * r.value))
        memory["a"], memory["b"] = bars, 1.0
        out = pd.DataFrame(taken, columns=["run", "iter", "score"])
        return out.astype({"iter": "int32"})

    return in_event_time(valid, step, "run string, iter int, score double", delay, expire)


HISTORY = "entity string, key bigint, cum_count bigint, since_last bigint"


def history_step(rows: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
    """Flags so far and rows since the last one, which a and b keep."""
    group, place = rows["group"].to_numpy(), np.arange(len(rows))
    first = np.append(True, group[1:] != group[:-1])
    start = np.maximum.accumulate(np.where(first, place, 0))
    hit = rows["flag"].to_numpy() == 1
    total = hit.cumsum()
    count = memory["a"].fillna(0).to_numpy().astype(np.int64)[group]
    since = memory["b"].fillna(-1).to_numpy().astype(np.int64)[group]
    cum = count + total - (total[start] - hit[start])
    last = np.maximum.accumulate(np.where(hit, place, -1))
    gap = np.where(last >= start, place - last, place - start + since + 1)
    ends = np.append(first[1:], True)
    memory.loc[group[ends], "a"] = cum[ends].astype(float)
    memory.loc[group[ends], "b"] = gap[ends].astype(float)
    return pd.DataFrame({"entity": rows["entity"], "key": rows["key"].astype("Int64").mask(rows["keyless"]),
                         "cum_count": cum.astype("int64"), "since_last": gap.astype("int64")})


def stream_history(events: DataFrame, entity: str, order: str, key: str, flag: str | Column,
                   delay: str = "1 hour", expire: str | None = None) -> DataFrame:
    """Running count of flagged rows and rows since the last, per entity."""
    hit = F.col(flag) if isinstance(flag, str) else flag
    rows = events.select(F.col(entity).cast("string").alias("entity"),
                         F.col(order).cast("timestamp").alias("at"),
                         F.col(key).cast("bigint").alias("key"),
                         F.coalesce(hit.cast("int"), F.lit(0)).alias("flag"))
    return in_event_time(rows, history_step, HISTORY, delay, expire)
