"""Task states: the last state of each task from its events, in batch and as a stream, with expiry and eviction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed")
RETENTION_HOURS, MOST_RECORDS = 24, 32


def current(events: DataFrame) -> DataFrame:
    """(task_id, state, since): the latest state of each task; a terminal state stays."""
    done = F.min(F.when(F.col("state").isin(*TERMINAL), F.struct("ts", "seq", "state")))
    last = F.max(F.struct("ts", "seq", "state"))
    one = events.groupBy("task_id").agg(F.coalesce(done, last).alias("s"))
    return one.select("task_id", "s.state", F.col("s.ts").alias("since"))


def expired(states: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    return states.filter(F.col("state").isin(*TERMINAL) & (F.col("since") < now - F.expr(f"interval {hours} hours")))


def evicted(states: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """The oldest terminal tasks beyond a number of records: all but those that a descending sort with a limit keeps."""
    done = states.filter(F.col("state").isin(*TERMINAL))
    kept = done.orderBy(F.desc("since"), F.desc("task_id")).limit(most).select("task_id")
    return done.join(kept, "task_id", "left_anti")


def queued_ahead(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event with the number of pending ones before it."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("queued_ahead", F.coalesce(F.sum(F.when(F.col("state") == "pending", 1).otherwise(0)).over(w), F.lit(0)))


def stream_states(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The state changes of each task over a stream of (task_id, seq, ts, state); a terminal state ends the task.

    Only ended tasks are forgotten, after RETENTION_HOURS: one that is still running may be idle for as long as it likes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (before,) = state.get if state.exists else ("",)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        changes = []
        for r in rows.itertuples():
            if before not in TERMINAL and r.state != before:
                changes.append((key[0], r.state, r.ts))
                before = r.state
        state.update((before,))
        if before in TERMINAL:
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + RETENTION_HOURS * 3_600_000)
        if changes:
            yield pd.DataFrame(changes, columns=["task_id", "state", "since"])

    timed = events.withWatermark("ts", watermark)
    return timed.groupBy("task_id").applyInPandasWithState(step, "task_id long, state string, since timestamp", "state string", "append", GroupStateTimeout.EventTimeTimeout)
