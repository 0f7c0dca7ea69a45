"""Exact event-time filter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog.functions.times import utc_moment
from decoylog.sources.lines import preset_hours


def time_range(events: DataFrame, preset: str, as_of: datetime | str) -> DataFrame:
    """Events of the last 1h / 24h / 7d / 30d before ``as_of``, or all of them.

    An unknown preset means 24h.  Bounded ranges leave out events without a
    valid time.  On the stored table the day partitions are pruned as well.
    """
    hours = preset_hours(preset)
    if hours is None:
        return events
    end = utc_moment(as_of)
    start = end - timedelta(hours=hours)
    micros = F.unix_micros("ts")
    within = (micros > _epoch_micros(start)) & (micros <= _epoch_micros(end))
    if "ts_ms" in events.columns:
        # A plain number has statistics in every row group, so this one skips them.
        within &= F.col("ts_ms").between(
            _epoch_micros(start) // 1000, _epoch_micros(end) // 1000
        )
    if "event_date" in events.columns:
        within &= F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))
    return events.where(within)


def _epoch_micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)
