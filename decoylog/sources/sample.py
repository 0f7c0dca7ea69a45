"""Log lines and events made from a generic ``events`` table.

The engine's input is a decoy server's log.  Where only an ``events`` table
(event_id, ts, user_id, event_type, ...) is at hand, these functions map every
one of its rows to one log line, with blank, malformed and undated lines mixed
in, so that each operator has something to work on.  Thirty days are squeezed
into thirty hours to make one-hour windows dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.times import ISO_MICROS
from decoylog.schema import EVENT_COLUMNS, JSON_FIELDS
from decoylog.session import use_utc
from decoylog.sources.lines import with_file_info

START_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
SECOND_DAY_US = 1_704_153_600_000_000
SQUEEZE = 24
AS_OF = "2024-01-02 06:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(events: DataFrame) -> DataFrame:
    micros = "unix_micros(cast(ts as timestamp))"
    ts_us = F.expr(f"{START_US} + ({micros} - {START_US}) div {SQUEEZE}")
    every = F.expr
    eventid = every(
        """case when event_id % 97 = 0 then null
        when event_type = 'error' then 'cowrie.login.failed'
        when event_type = 'signup' and event_id % 4 = 0 then 'cowrie.login.success'
        when event_type = 'signup' then 'cowrie.session.connect'
        when event_type = 'view' then element_at(array('cowrie.session.connect',
            'cowrie.session.closed', 'cowrie.client.version', 'cowrie.client.kex'),
            cast(event_id % 4 as int) + 1)
        when event_type = 'click' then 'cowrie.command.input'
        when event_type = 'purchase' then element_at(array('cowrie.session.file_download',
            'cowrie.direct-tcpip.data', 'cowrie.direct-tcpip.request',
            'cowrie.session.file_upload', 'custom.event'), cast(event_id % 5 as int) + 1)
        end"""
    )
    crlf = "concat(chr(92), 'r', chr(92), 'n')"
    return events.select(
        ts_us.alias("ts_us"),
        every(
            """case when event_id % 73 = 0 then 'blank' when event_id % 89 = 0 then 'malformed'
            when event_id % 83 = 0 then 'no_timestamp' when event_id % 79 = 0 then 'bad_timestamp'
            else 'ok' end"""
        ).alias("line_status"),
        eventid.alias("eventid"),
        every("concat('s', event_id div 10)").alias("session"),
        every(
            """case when event_id % 50 = 0 then null
            when user_id < 90 then concat('192.0.2.', user_id % 5)
            when user_id % 2 = 0 then concat('198.51.100.', user_id % 256)
            else concat('203.0.113.', user_id % 256) end"""
        ).alias("src_ip"),
        every("cast(1024 + event_id % 60000 as int)").alias("src_port"),
        F.lit("192.0.2.250").alias("dst_ip"),
        F.lit(2222).alias("dst_port"),
        every("case when event_id % 11 <> 0 then concat('u', user_id % 7) end").alias("username"),
        every(
            """case when event_id % 13 = 0 then '' when event_id % 17 = 0 then 'a:b'
            else concat('p', event_id % 5) end"""
        ).alias("password"),
        every(
            """case event_id % 8 when 0 then '  ' when 1 then 'uname -a' when 2 then ' sudo su '
            when 3 then 'cat /etc/passwd' when 4 then 'wget https://x.test/a'
            when 5 then concat('echo ', repeat('A', 120)) when 6 then 'LS /etc'
            else 'GET h.test/p1' end"""
        ).alias("input"),
        every(
            f"""case event_id % 4
            when 0 then concat('GET /p', event_id % 3, ' HTTP/1.1', {crlf}, 'Host: h.test', {crlf})
            when 1 then concat('post /x HTTP/1.1', chr(10), 'host:  k.test ', chr(10))
            when 2 then 'POST /GET HTTP/1.0' else 'binary' end"""
        ).alias("data"),
        every(
            """case when event_id % 15 <> 0 then concat('http://h.test/', event_id % 3,
            element_at(array('.sh', '.EXE', '.exe', '.bin'), cast((event_id div 5) % 4 as int) + 1))
            end"""
        ).alias("url"),
        every("concat('event ', event_id)").alias("message"),
        F.lit("ssh").alias("protocol"),
        "event_id",
    ).withColumns(
        {
            "file_name": F.when(
                F.col("ts_us") < SECOND_DAY_US, F.lit(C.ARCHIVE_PREFIX + "2024-01-01")
            ).otherwise(C.LIVE_FILE),
            "timestamp": F.when(
                F.col("line_status") == C.OK,
                F.date_format(F.timestamp_micros("ts_us"), ISO_MICROS),
            ).when(
                F.col("line_status") == C.BAD_TIMESTAMP,
                every(
                    """element_at(array('not-a-date', '20240101', '{}', '[1]'),
                    cast(event_id % 4 as int) + 1)"""
                ),
            ),
        }
    )


def sample_lines(events: DataFrame) -> DataFrame:
    """One raw line (``value``, ``file_name``) per row of the table."""
    document = F.to_json(F.struct(*JSON_FIELDS))
    # Rejects and odd times come in several forms, by the event's number.
    number = F.col("event_id")

    def one_of(*forms: Column) -> Column:
        return F.element_at(F.array(*forms), (number % len(forms) + 1).cast("int"))

    def timed(json: str) -> Column:
        rest = F.to_json(F.struct(*[f for f in JSON_FIELDS if f != "timestamp"]))
        return F.concat(F.lit('{"timestamp":' + json + ","), F.substr(rest, F.lit(2)))

    value = (
        F.when(F.col("line_status") == C.BLANK, one_of(F.lit(""), F.lit(" \t"), F.lit("\u00a0")))
        .when(
            F.col("line_status") == C.MALFORMED,
            one_of(
                F.lit("{bad"),
                F.lit('{"timestamp":"2024-01-01T00:00:00Z"}],"}'),
                F.lit('{"timestamp":"2024-01-01T00:00:00Z"}],[{}'),
                F.lit('{"timestamp":"2024-01-01T00:00:00Z"} x'),
                F.lit("null"),
            ),
        )
        .when(
            F.col("line_status") == C.NO_TIMESTAMP,
            one_of(document, timed("false"), timed("0"), timed('""'), timed("null")),
        )
        .when(
            F.col("line_status") == C.BAD_TIMESTAMP,
            one_of(document, document, timed("{}"), timed("[1]")),
        )
        # Of equal keys the last one counts.
        .when(number % 7 == 0, F.concat(F.lit('{"timestamp":"x",'), F.substr(document, F.lit(2))))
        .otherwise(document)
    )
    return with_file_info(_mapped(events).select(value.alias("value"), "file_name"))


def sample_events(events: DataFrame) -> DataFrame:
    """The admitted events of :func:`sample_lines`, without the JSON round trip."""
    ts = F.when(F.col("line_status") == C.OK, F.timestamp_micros("ts_us"))
    mapped = _mapped(events).where(F.col("line_status").isin(*C.ADMITTED))
    return (
        mapped.withColumn("ts", ts)
        .withColumn("ts_ms", F.unix_millis("ts"))
        .select(*EVENT_COLUMNS, "file_name", "line_status")
    )


def sample_geo_ranges(spark: SparkSession) -> DataFrame:
    """Three documentation-only networks with invented countries."""
    return spark.sql(
        """SELECT * FROM VALUES
        (3221225984L, 3221226239L, 'AA', 'A1', 'Alpha', '0', 'Etc/UTC', array(1.5D, 2.5D), 0, 10),
        (3325256704L, 3325256831L, 'BB', 'B1', 'Beta', '1', 'Etc/UTC', array(3.5D, 4.5D), 0, 20),
        (3405803776L, 3405804031L, 'CC', NULL, NULL, '0', 'Etc/UTC', array(5.5D, 6.5D), 0, 50)
        AS geo(lo, hi, country, region, city, eu, timezone, ll, metro, area)"""
    )
