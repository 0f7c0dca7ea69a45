import json

import pytest
from pyspark.sql import functions as F

from decoylog import nonblank, parse_events, parse_lines, rejects
from decoylog.functions.times import parse_time

GOOD = '{"timestamp":"2024-01-01T00:00:00.123456Z","eventid":"a"}'

STATES = [
    (GOOD, "ok"),
    (GOOD + "\r", "ok"),
    ("  " + GOOD + " ", "ok"),
    ("", "blank"),
    (" \t", "blank"),
    (" 　", "blank"),
    ("{bad", "malformed"),
    ("5", "malformed"),
    ("null", "malformed"),
    ('"text"', "malformed"),
    ('[{"timestamp":"x"}]', "malformed"),
    ("[]", "malformed"),
    ('{"timestamp":"x"} trailing', "malformed"),
    ('{"timestamp":"x"}{"timestamp":"y"}', "malformed"),
    ('{"timestamp":"x"},{"timestamp":"y"}', "malformed"),
    ('{"timestamp":"x"}]', "malformed"),
    ('{"timestamp":"x",}', "malformed"),
    ("{'timestamp':'x'}", "malformed"),
    ('{"timestamp":NaN}', "malformed"),
    ('﻿{"timestamp":"x"}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z"}],"}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z"}],[{}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z"}]}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z"}}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z"},"x":{}', "malformed"),
    ('{"timestamp":"2024-01-01T00:00:00Z","a":[{"b":1}]}', "ok"),
    ('{"timestamp":"2024-01-01T00:00:00Z","a":"}] x"}', "ok"),
    ('{"timestamp":"x","timestamp":"2024-01-01T00:00:00Z"}', "ok"),
    ("{}", "no_timestamp"),
    ('{"timestamp":false}', "no_timestamp"),
    ('{"timestamp":0}', "no_timestamp"),
    ('{"timestamp":0.0}', "no_timestamp"),
    ('{"timestamp":{}}', "bad_timestamp"),
    ('{"timestamp":[]}', "bad_timestamp"),
    ('{"timestamp":"20240101"}', "bad_timestamp"),
    ('{"timestamp":"1704067200000"}', "bad_timestamp"),
    ('{"timestamp":5}', "ok"),
    ('{"timestamp":-1.5}', "ok"),
    ('{"timestamp":1e30}', "bad_timestamp"),
    ('{"timestamp":""}', "no_timestamp"),
    ('{"timestamp":null}', "no_timestamp"),
    ('{"timestamp":"not-a-date"}', "bad_timestamp"),
    ('{"timestamp":"12:34"}', "bad_timestamp"),
    ('{"timestamp":1704067200000}', "ok"),
    ('{"timestamp":"2024-01-01"}', "ok"),
]


def test_line_states(lines_of):
    parsed = parse_lines(lines_of([line for line, _ in STATES])).select("value", "line_status")
    assert {row["value"]: row["line_status"] for row in parsed.collect()} == dict(STATES)


def test_admitted_and_rejected(lines_of):
    lines = lines_of([line for line, _ in STATES])
    wanted = [state for _, state in STATES]
    admitted = sum(state in ("ok", "bad_timestamp") for state in wanted)
    rejected = sum(state in ("malformed", "no_timestamp") for state in wanted)
    assert parse_events(lines).count() == admitted
    assert rejects(parse_lines(lines)).count() == rejected
    assert nonblank(lines).count() == admitted + rejected


def test_last_duplicate_key_wins(lines_of):
    line = '{"timestamp":"2024-01-01","input":"a","input":"b"}'
    assert parse_events(lines_of([line])).first()["input"] == "b"


@pytest.mark.parametrize(
    ("value", "text"), [("7", "7"), ('{"z":1}', '{"z":1}'), ("true", "true"), ("null", None)]
)
def test_values_of_other_types_become_text(lines_of, value, text):
    line = f'{{"timestamp":"2024-01-01","input":{value}}}'
    assert parse_events(lines_of([line])).first()["input"] == text


def test_ports_are_integers_and_bad_ports_are_null(lines_of):
    lines = [
        json.dumps({"timestamp": "2024-01-01", "src_port": port}) for port in (22, "23", "x", 10**12)
    ]
    ports = [row["src_port"] for row in parse_events(lines_of(lines)).collect()]
    assert ports == [22, 23, None, None]


def test_milliseconds_are_cut_not_rounded(lines_of):
    row = parse_events(lines_of(['{"timestamp":"2024-01-01T00:00:00.123999Z"}'])).first()
    assert row["ts_ms"] == 1704067200123


@pytest.mark.parametrize(
    ("text", "millis"),
    [
        ("2024-01-01T00:00:00Z", 1704067200000),
        ("2024-01-01T02:00:00+02:00", 1704067200000),
        ("2024-01-01 00:00:00", 1704067200000),
        ("1704067200000", None),
        ("-86400000", None),
        ("99999999999999999", None),
        ("999999999999999999999999", None),
        ("T12:00", None),
        ("2024-13-01", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, millis):
    frame = spark.createDataFrame([(text,)], "s string")
    assert frame.select(F.unix_millis(parse_time(F.col("s")))).first()[0] == millis


def test_a_filter_does_not_parse_twice(lines_of, plans):
    plan, _ = plans
    events = parse_events(lines_of([GOOD])).where("eventid = 'a'").groupBy("src_ip").count()
    # One parse of the line, and two that few lines need: whether it is closed, and what
    # type a time has that does not begin like one.
    assert plan(events).count("from_json") == 3


def test_fewer_fields_do_not_change_the_states(lines_of):
    lines = lines_of([line for line, _ in STATES])
    narrow = parse_lines(lines, ["eventid"])
    assert "src_ip" not in narrow.columns
    assert {r["value"]: r["line_status"] for r in narrow.collect()} == dict(STATES)
