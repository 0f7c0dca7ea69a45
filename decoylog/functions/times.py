"""Reading and rendering of event times (session zone UTC)."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest distance from the epoch, in milliseconds, a log time may have.
_MAX_EPOCH_MS = 8_640_000_000_000_000

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def parse_time(text: Column) -> Column:
    """ISO-8601 text as an instant; NULL when it is none.

    It must begin with a four-digit year: Spark would read a bare clock time as
    today's, which depends on when the job runs.
    """
    return F.when(text.rlike(r"^\d{4}(-|$)"), F.try_to_timestamp(text))


def epoch_time(number: Column) -> Column:
    """Epoch milliseconds as an instant, of whatever size; NULL out of range."""
    millis = number.try_cast("double")
    whole = millis.try_cast("bigint")
    return F.when(F.abs(millis) <= _MAX_EPOCH_MS, F.timestamp_millis(whole))


# --- a JSON value of any type (variant): decided by its type, not its look ---


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def json_text(value: Column) -> Column:
    """The text of a JSON value: a string's content, JSON for all else."""
    scalar = F.try_variant_get(value, "$", "string")
    given = value.isNotNull() & ~F.is_variant_null(value)
    return F.when(given, F.coalesce(scalar, F.to_json(value)))


def json_time(value: Column) -> Column:
    """A JSON text as ISO-8601, a JSON number as epoch milliseconds."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), None)
        .when(F.schema_of_variant(value) == "STRING", parse_time(text))
        .when(_is_number(value), epoch_time(F.try_variant_get(value, "$", "double")))
    )


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as given: not empty text, zero, false or null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(
        F.when(value.isNull() | F.is_variant_null(value), False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(_is_number(value), F.try_variant_get(value, "$", "double") != 0)
        .otherwise(True),
        F.lit(False),
    )


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, ISO_MICROS)


def viewer_time(ts: Column, tz: str) -> Column:
    """Wall-clock text in the viewer's zone."""
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss")


def utc_moment(as_of: datetime | date | str) -> datetime:
    """A point in time as a zone-less UTC value; zone-less input counts as UTC."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    return as_of.astimezone(UTC).replace(tzinfo=None) if as_of.tzinfo else as_of


def moment(as_of: datetime | date | str) -> Column:
    """A point in time as a column, whatever the session's zone."""
    since = utc_moment(as_of) - datetime(1970, 1, 1)
    return F.timestamp_micros(F.lit(since // timedelta(microseconds=1)))


def millis(length: timedelta) -> int:
    return length // timedelta(milliseconds=1)


def interval_text(length: timedelta) -> str:
    """A duration as Spark's ``window`` and ``withWatermark`` take it."""
    return f"{millis(length)} milliseconds"
