"""Row shapes: one log event, one geo record, one stored line."""

from pyspark.sql import types as T

#: Fields taken from the JSON object, all read as text first so that a value of
#: an unexpected JSON type never turns a whole line into a reject.
JSON_FIELDS = (
    "timestamp",
    "eventid",
    "session",
    "src_ip",
    "src_port",
    "dst_ip",
    "dst_port",
    "username",
    "password",
    "input",
    "data",
    "url",
    "message",
    "protocol",
)

INT_FIELDS = ("src_port", "dst_port")

JSON_OBJECT = T.StructType([T.StructField(name, T.StringType()) for name in JSON_FIELDS])

EVENT = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name in INT_FIELDS else T.StringType())
        for name in JSON_FIELDS
    ]
    + [T.StructField("ts", T.TimestampType()), T.StructField("ts_ms", T.LongType())]
)

EVENT_COLUMNS = tuple(EVENT.fieldNames())

LOCATION = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("range", T.ArrayType(T.LongType())),
        T.StructField("eu", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("ll", T.ArrayType(T.DoubleType())),
        T.StructField("metro", T.IntegerType()),
        T.StructField("area", T.IntegerType()),
    ]
)

#: Geo dimension: inclusive, non-overlapping ranges.  ``lo``/``hi`` are either
#: IPv4 numbers (bigint) or address texts (string, IPv4 and IPv6 mixed).
GEO_RANGES = T.StructType(
    [
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("eu", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("ll", T.ArrayType(T.DoubleType())),
        T.StructField("metro", T.IntegerType()),
        T.StructField("area", T.IntegerType()),
    ]
)
