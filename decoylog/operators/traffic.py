"""Who connects, from where, how often and when."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import event_name
from decoylog.functions.text import empty_to_null, present
from decoylog.functions.times import interval_text
from decoylog.operators.geo import with_location


def with_event_name(events: DataFrame) -> DataFrame:
    return events.withColumn("event_name", event_name(F.col("eventid")))


def events_by_type(events: DataFrame) -> DataFrame:
    """Events per display name, most frequent first.

    Counted per raw code first, so names are looked up once per code and not
    once per event; a code that equals another's display name still merges.
    """
    per_code = events.groupBy("eventid").agg(F.count(F.lit(1)).alias("n"))
    return (
        with_event_name(per_code)
        .groupBy("event_name")
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("count"), "event_name")
    )


def overview_columns() -> list[Column]:
    """The aggregates of :func:`overview`.

    The two exact distinct counts make Spark expand each row threefold before
    the partial aggregate, which merges them again per task.
    """
    start, end = F.min("ts"), F.max("ts")
    return [
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct(empty_to_null(F.col("session"))).alias("total_sessions"),
        F.countDistinct(empty_to_null(F.col("src_ip"))).alias("unique_ips"),
        start.alias("start"),
        end.alias("end"),
        (F.unix_millis(end) - F.unix_millis(start)).alias("duration_ms"),
    ]


def overview(events: DataFrame) -> DataFrame:
    """One row: totals, distinct sessions and addresses, first and last time.

    Start and end are the true minimum and maximum of the valid times.
    """
    return events.agg(*overview_columns())


def ip_activity(events: DataFrame) -> DataFrame:
    """Per source address: events, first and last valid time."""
    return (
        events.where(present(F.col("src_ip")))
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )


def top_source_ips(
    events: DataFrame, geo: DataFrame | None = None, limit: int = C.TOP_LIMIT
) -> DataFrame:
    """The busiest source addresses; only those kept are looked up."""
    order = (F.desc("count"), F.asc("src_ip"))
    top = ip_activity(events).orderBy(*order).limit(limit)
    # The limit repeats only to order the few rows without a range shuffle.
    return with_location(top, geo, each_row=True).orderBy(*order).limit(limit)


def geographic_distribution(events: DataFrame, geo: DataFrame) -> DataFrame:
    """Events and distinct addresses per country; unlocated addresses are left out.

    Counted per address first: the lookup then sees each address once and the
    distinct count becomes a plain count.
    """
    per_ip = (
        events.where(present(F.col("src_ip")))
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        with_location(per_ip, geo, each_row=True)
        .select("n", F.col("location.country").alias("country"))
        .where(present(F.col("country")))
        .groupBy("country")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_ips"))
        .orderBy(F.desc("count"), "country")
    )


def sessions_over_time(
    events: DataFrame, interval: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Connects and disconnects per epoch-aligned interval that has any."""
    return session_counts(events, interval).orderBy("interval_start")


def session_counts(events: DataFrame, interval: timedelta) -> DataFrame:
    """Unsorted form, for batch and streaming frames alike."""
    return (
        events.where(F.col("eventid").isin(C.SESSION_CONNECT, C.SESSION_CLOSED))
        .groupBy(F.window("ts", interval_text(interval)).alias("w"))
        .agg(
            F.count_if(F.col("eventid") == C.SESSION_CONNECT).alias("connects"),
            F.count_if(F.col("eventid") == C.SESSION_CLOSED).alias("disconnects"),
        )
        .select(F.col("w.start").alias("interval_start"), "connects", "disconnects")
    )
