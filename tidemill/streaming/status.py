"""Status of jobs over a stream: working from an event on, and idle again when a time without events has passed.

Events of a job may come in any order within the watermark's delay. They wait in the job's state until the watermark has passed
them, and are then taken in order of time. So the transitions don't depend on how events are dealt over micro-batches, and
are those that ``operators.islands.transitions`` finds in all events that weren't late. A timer per job is set for what is due next: the
earliest waiting event, or the end of its working time. State and timers are in the checkpoint; a restart goes on from there.

Defined cases: an event at or before the watermark is late and dropped by Spark; so is one without a time, and a null job is a job.
Of a job's state, only the events within the watermark's delay are held, 8 bytes each.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE, WORKING = "idle", "working"
_STATE = "waiting binary, last long, working boolean"


def advance(waiting: np.ndarray, last: int, working: bool, before: int, timeout: int) -> tuple[np.ndarray, int, bool, list[tuple[int, str]]]:
    """The state after all that is due before a moment, and the transitions on the way; all in microseconds.

    waiting: times of events, sorted; last: the last event taken; timeout: the time after which a job is idle.
    """
    due, waiting = waiting[: (n := int(np.searchsorted(waiting, before)))], waiting[n:]
    moments = np.concatenate((np.array([last], np.int64), due)) if working else due
    found = []
    if len(moments):
        gaps = np.flatnonzero(np.diff(moments) > timeout)
        if not working:
            found.append((int(moments[0]), WORKING))
        for i in gaps.tolist():
            found += [(int(moments[i]) + timeout, IDLE), (int(moments[i + 1]), WORKING)]
        last, working = int(moments[-1]), True
    if working and last + timeout < before:
        found.append((last + timeout, IDLE))
        working = False
    return waiting, last, working, found


def _follow(timeout: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, working = state.get if state.exists else (b"", 0, False)
        new = [np.frombuffer(held, "<i8")]
        if not state.hasTimedOut:
            new += [frame["at"].to_numpy(np.int64) for frame in frames]
        # What is due before the watermark can't change any more.
        passed = state.getCurrentWatermarkMs() * 1000
        waiting, last, working, found = advance(np.sort(np.concatenate(new)), last, working, passed, timeout)
        if len(waiting) or working:
            state.update((waiting.astype("<i8").tobytes(), last, working))
            due = min([*waiting[:1].tolist(), *[last + timeout] * working])
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()))
        else:
            state.remove()
        yield pd.DataFrame({"job": [key[0]] * len(found), "at_micros": [at for at, _ in found], "status": [s for _, s in found]})

    return run


def transitions(events: DataFrame, key: str, ts: str, timeout: int, delay: int) -> DataFrame:
    """key, changed_at, status of a stream's jobs. timeout and delay (of the watermark) in seconds."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(F.col(key).alias("job"), F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", f"{delay} seconds")
    found = timed.withColumn("at", F.unix_micros("ts")).groupBy("job").applyInPandasWithState(_follow(timeout * 1_000_000), f"job {kind}, at_micros long, status string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("job").alias(key), F.timestamp_micros("at_micros").alias("changed_at"), "status")
