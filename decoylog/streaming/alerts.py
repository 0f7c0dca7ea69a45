"""Alerts: rule matches as they arrive, brute force once a window can be judged."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from decoylog import constants as C
from decoylog.functions.times import interval_text, millis
from decoylog.operators.detect import (
    attempt_counts,
    detections,
    first_windows,
    slot_of,
    slots_of,
    timed_attempts,
    windows_over,
)
from decoylog.operators.geo import with_location
from decoylog.streaming.metrics import DEFAULT_DELAY
from decoylog.streaming.sinks import start_batched

# Tasks get this module's functions with their work, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def start_detection_alerts(
    events: DataFrame,
    geo: DataFrame | None,
    path: str,
    checkpoint: str,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Malware, escalation and reconnaissance matches, located per micro-batch."""
    return start_batched(
        detections(events),
        path,
        checkpoint,
        processing_time=processing_time,
        finish=lambda batch: with_location(batch, geo, each_row=True),
    )


def closed_slots(events: DataFrame, window: timedelta, delay: timedelta) -> DataFrame:
    """Failures per (address, slot, millisecond), given out when a slot is over.

    The sliding event-time window of two slots holds all that the windows which
    open in its first slot can see.  Its state is one count per millisecond with
    attempts, spread over (address, slot, millisecond), so neither a burst nor a
    dominant address makes a large state or a hot task.  It is dropped when the
    watermark has passed.
    """
    window_ms = millis(window)
    two_slots = F.window("ts", interval_text(2 * window), interval_text(window))
    return (
        timed_attempts(events)
        .withWatermark("ts", interval_text(delay))
        .groupBy(two_slots.alias("w"), "src_ip", "ts_ms")
        .agg(F.count_if(F.col("eventid") == C.LOGIN_FAILED).alias("failed"))
        .select(
            "src_ip",
            slot_of(F.unix_millis("w.start"), window_ms).alias("slot"),
            F.col("ts_ms").alias("at"),
            "failed",
        )
    )


def start_brute_force_alerts(
    events: DataFrame,
    path: str,
    checkpoint: str,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
    delay: timedelta = DEFAULT_DELAY,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Windows over the threshold, written when the slot they open in is over.

    An attempt that arrives more than ``delay`` behind the newest one may be
    left out.  All counts of a slot come out in the same micro-batch, so the
    batch operator's sums finish the job there.  :func:`first_alerts` reduces
    the alerts to one per address, as in the batch operator.
    """
    return start_batched(
        closed_slots(events, window, delay),
        path,
        checkpoint,
        processing_time=processing_time,
        finish=lambda counted: windows_over(counted, threshold, millis(window)),
    )


def _per_millisecond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attempts of a batch, counted per (address, millisecond) before they are moved."""
    for batch in batches:
        counts = pa.table(batch).group_by(["src_ip", "ts_ms"]).aggregate(
            [("failed", "sum"), ("ts", "max")]
        )
        yield from counts.rename_columns(["src_ip", "ts_ms", "failed", "ts"]).to_batches()


def judge_windows(
    times: np.ndarray, failed: np.ndarray, threshold: int, window_ms: int, passed_ms: int
) -> tuple[int | None, int]:
    """The first judged attempt whose window is over the threshold, and how many are judged.

    ``times`` ascend without repeats.  An attempt is judged once nothing can join its
    window any more, that is when its end has passed.
    """
    judged = int(np.searchsorted(times, passed_ms - window_ms, side="left"))
    sums = np.concatenate([[0], np.cumsum(failed)])
    ends = np.searchsorted(times, times[:judged] + window_ms, side="right")
    over = np.flatnonzero(sums[ends] - sums[:judged] >= threshold)
    return (int(over[0]) if len(over) else None), judged


def keyed_alerts(
    events: DataFrame,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
    delay: timedelta = DEFAULT_DELAY,
) -> DataFrame:
    """Brute force as it can be told: one row per address, once its window is over.

    For append mode.  The state of an address is its attempts, as counts per
    millisecond in order, as far back as the oldest one that is not judged: one
    window and the watermark's delay.  A timer at that attempt's window end brings
    the address up when the watermark passes it.  The alert is the batch operator's
    row for all attempts that were not late; after it only a mark is kept.  A row of
    the shuffle is an (address, millisecond) with its counts, made where it is read.
    """
    window_ms = millis(window)

    def update(
        key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [], False)
        new = [f for f in frames if len(f)]
        if old[2]:
            return
        times = np.concatenate([np.array(old[0], np.int64), *[f["ts_ms"].to_numpy() for f in new]])
        counts = np.concatenate([np.array(old[1], np.int64), *[f["failed"].to_numpy() for f in new]])
        times, at = np.unique(times, return_inverse=True)
        failed = np.bincount(at, counts, len(times)).astype(np.int64)
        passed = state.getCurrentWatermarkMs()
        found, judged = judge_windows(times, failed, threshold, window_ms, passed)
        if found is not None:
            start = int(times[found])
            inside = int(failed[(times >= start) & (times <= start + window_ms)].sum())
            state.update(([], [], True))
            yield pd.DataFrame({"src_ip": [key[0]], "failed_attempts": [inside], "start_ms": [start]})
            return
        times, failed = times[judged:], failed[judged:]
        if not len(times):
            state.remove()
            return
        state.update((times.tolist(), failed.tolist(), False))
        state.setTimeoutTimestamp(max(int(times[0]) + window_ms, passed) + 1)

    attempts = timed_attempts(events).select(
        "src_ip", "ts_ms", (F.col("eventid") == C.LOGIN_FAILED).cast("bigint").alias("failed"), "ts"
    )
    found = (
        attempts.mapInArrow(_per_millisecond, attempts.schema)
        .withWatermark("ts", interval_text(delay))
        .groupBy("src_ip")
        .applyInPandasWithState(
            update,
            "src_ip string, failed_attempts bigint, start_ms bigint",
            "times array<bigint>, failed array<bigint>, done boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return found.select(
        "src_ip",
        "failed_attempts",
        F.timestamp_millis("start_ms").alias("window_start"),
        F.timestamp_millis(F.col("start_ms") + window_ms).alias("window_end"),
    )


def start_attempt_counts(
    events: DataFrame, path: str, checkpoint: str, processing_time: str | None = None
) -> StreamingQuery:
    """Failures per (address, millisecond) of each micro-batch, for exact results.

    There is no state and no watermark: counts of the same millisecond from
    several batches add up when they are read, however late they come.
    """
    return start_batched(
        timed_attempts(events).select("src_ip", "ts_ms", "eventid"),
        path,
        checkpoint,
        processing_time=processing_time,
        finish=attempt_counts,
    )


def brute_force_so_far(
    counts: DataFrame,
    geo: DataFrame | None = None,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
) -> DataFrame:
    """What the batch operator gives for all attempts counted so far."""
    whole = counts.groupBy("src_ip", "ts_ms").agg(F.sum("failed").alias("failed"))
    window_ms = millis(window)
    windows = windows_over(slots_of(whole, window_ms), threshold, window_ms)
    return with_location(first_windows(windows, window_ms), geo, each_row=True)


def first_alerts(
    alerts: DataFrame, geo: DataFrame | None = None, window: timedelta = C.BRUTE_FORCE_WINDOW
) -> DataFrame:
    """One row per address: its earliest alert, in the batch operator's shape."""
    return with_location(first_windows(alerts, millis(window)), geo, each_row=True)
