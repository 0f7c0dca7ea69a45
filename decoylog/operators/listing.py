"""Event listings as a viewer sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import location_label, masked_password, severity
from decoylog.functions.text import present
from decoylog.functions.times import viewer_time
from decoylog.operators.geo import with_location


def with_severity(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", severity(F.col("eventid")))


def recent_logs(events: DataFrame, limit: int = C.RECENT_LIMIT) -> DataFrame:
    """The latest events by time; undated ones come last, ties go by content."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    tie_break = [c for c in ("session", "message", "src_ip", "eventid") if c in events.columns]
    return events.orderBy(F.desc_nulls_last("ts"), *tie_break).limit(limit)


def log_table(
    events: DataFrame, geo: DataFrame | None = None, tz: str = "UTC", each_row: bool = False
) -> DataFrame:
    """Display rows: local time, location label, severity, masked password.

    ``each_row`` as in :func:`with_location`; set it for a limited listing.
    """
    shown = events.select("ts", "src_ip", "eventid", "username", "password", "message")
    return with_location(shown, geo, each_row=each_row).select(
        viewer_time(F.col("ts"), tz).alias("time"),
        "src_ip",
        location_label(F.col("location")).alias("location"),
        "eventid",
        severity(F.col("eventid")).alias("severity"),
        F.when(present(F.col("username")), F.col("username")).otherwise("NULL").alias("username"),
        masked_password(F.col("password")).alias("password"),
        "message",
    )
