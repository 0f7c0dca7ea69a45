"""What the files hold: line counts, validity, inventory.

All three take the result of ``parse_lines``, which keeps every line; the fields
in ``QUALITY_FIELDS`` are enough for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C


QUALITY_FIELDS = ("timestamp", "eventid")


def _lines_in(state: str) -> Column:
    return F.count_if(F.col("line_status") == state)


def ingest_stats(parsed: DataFrame, data_source: str = "log_files") -> DataFrame:
    """One row: non-blank lines, files they come from, tag of the source."""
    content = F.col("line_status") != C.BLANK
    return parsed.agg(
        F.count_if(content).alias("total_lines"),
        F.countDistinct("file_name").alias("files_processed"),
        F.when(F.count_if(content) > 0, data_source).otherwise("no_data").alias("data_source"),
    )


def validate_logs(parsed: DataFrame) -> DataFrame:
    """Per file: lines by state, and admitted events with an unlisted code."""
    unlisted = (
        F.col("line_status").isin(*C.ADMITTED)
        & F.col("eventid").isNotNull()
        & ~F.col("eventid").isin(*C.EVENT_NAMES)
    )
    missing = F.col("line_status").isin(*C.ADMITTED) & F.col("eventid").isNull()
    return parsed.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("lines"),
        _lines_in(C.OK).alias("ok"),
        _lines_in(C.BLANK).alias("blank"),
        _lines_in(C.MALFORMED).alias("malformed"),
        _lines_in(C.NO_TIMESTAMP).alias("no_timestamp"),
        _lines_in(C.BAD_TIMESTAMP).alias("bad_timestamp"),
        F.count_if(unlisted).alias("unknown_eventid"),
        F.count_if(missing).alias("missing_eventid"),
    )


def log_file_inventory(parsed: DataFrame) -> DataFrame:
    """Per file: layout, day, lines, bytes of text, first and last event time."""
    return parsed.groupBy("file_name", "layout", "log_date").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("value")).alias("text_bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
