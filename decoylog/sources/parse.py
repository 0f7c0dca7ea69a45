"""Lines to events.

A line is an event when it is one JSON object and nothing else.  Spark's parser
ignores what follows the value it was asked for, so a line is read wrapped: as
the single element of an array, where text behind the object is an error.  The
one thing such a line can still do is close the array itself, with a bracket
behind a brace; lines that hold that pair are read a second time as the value of
an object, which a bracket cannot close.  Text that passes both is one value.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoylog import constants as C
from decoylog.functions.rows import once
from decoylog.functions.text import is_blank
from decoylog.functions.times import json_text, json_time, parse_time, truthy
from decoylog.schema import INT_FIELDS, JSON_FIELDS, JSON_OBJECT

_STRICT = {
    "mode": "PERMISSIVE",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def parse_lines(lines: DataFrame, fields: Collection[str] = JSON_FIELDS) -> DataFrame:
    """Every line with its ``line_status`` and, where there are any, event columns.

    Keeps the columns of ``lines``.  States: ``ok``, ``bad_timestamp`` (admitted,
    but without ``ts``), ``no_timestamp``, ``malformed`` and ``blank``.  Rejects
    stay in the result; :func:`admitted` and :func:`rejects` split it.

    ``fields`` narrows the event columns to those a report needs (``timestamp``
    is always among them); the others are then skipped while parsing.
    """
    kept = [name for name in JSON_FIELDS if name in fields or name == "timestamp"]
    value = F.col("value")
    wrapped = F.concat(F.lit("["), value, F.lit("\n]"))
    shape = T.ArrayType(T.StructType([JSON_OBJECT[name] for name in kept]))
    as_member = F.from_json(
        F.concat(F.lit('{"line":'), value, F.lit("\n}")), "map<string, string>", _STRICT
    )
    # A second parse, of the few lines with that pair only.
    single = (
        ~value.contains("]")
        | ~value.rlike(r"\}[ \t\r\n]*\]")
        | F.coalesce(F.map_keys(as_member) == F.array(F.lit("line")), F.lit(False))
    )
    closed = (value.endswith("}") | value.rlike(r"\}[ \t\r\n]+$")) & single
    objects = F.col("_objects")
    one = F.when((F.size(objects) == 1) & closed, F.get(objects, F.lit(0)))
    # Text that begins like this can only have been a JSON text; of any other the type
    # decides what it means, which its variant tells.
    text, odd = F.col("_object.timestamp"), F.col("_odd")
    timed = T.ArrayType(T.StructType([T.StructField("timestamp", T.VariantType())]))
    typed = F.get(F.from_json(wrapped, timed, _STRICT), F.lit(0))["timestamp"]
    plain = odd.isNull()
    time = F.struct(
        F.when(plain, parse_time(text)).otherwise(json_time(odd)).alias("_ts"),
        F.when(plain, text).otherwise(json_text(odd)).alias("_text"),
        F.when(plain, text.isNotNull()).otherwise(truthy(odd)).alias("_given"),
    )
    rows = once(lines, F.struct(F.from_json(wrapped, shape, _STRICT).alias("_objects")))
    rows = once(rows, F.struct(one.alias("_object")))
    rows = once(rows, F.struct(F.when(~text.rlike(r"^\d{4}-"), typed).alias("_odd")))
    rows = once(rows, time)
    return rows.select(*[F.col(f"`{name}`") for name in lines.columns], *_event_columns(kept))


def _event_columns(kept: list[str]) -> list[Column]:
    def field(name: str) -> Column:
        if name == "timestamp":
            return F.col("_text")
        found = F.col(f"_object.{name}")
        return found.try_cast("int") if name in INT_FIELDS else found

    ts, given = F.col("_ts"), F.col("_given")
    status = (
        F.when(ts.isNotNull() & given, C.OK)
        .when(given, C.BAD_TIMESTAMP)
        .when(F.col("_object").isNotNull(), C.NO_TIMESTAMP)
        .when(is_blank(F.col("value")), C.BLANK)
        .otherwise(C.MALFORMED)
    )
    return [
        *[field(name).alias(name) for name in kept],
        F.when(given, ts).alias("ts"),
        F.when(given, F.unix_millis(ts)).alias("ts_ms"),
        status.alias("line_status"),
    ]


def admitted(parsed: DataFrame) -> DataFrame:
    """The events all reports count: an object with a timestamp other than an empty
    text, zero, false or null."""
    return parsed.where(F.col("line_status").isin(*C.ADMITTED))


def rejects(parsed: DataFrame) -> DataFrame:
    """Non-blank lines that are no events, kept for inspection."""
    return parsed.where(F.col("line_status").isin(C.MALFORMED, C.NO_TIMESTAMP))


def parse_events(lines: DataFrame) -> DataFrame:
    """Admitted events of raw lines, without the raw text."""
    return admitted(parse_lines(lines)).drop("value")
