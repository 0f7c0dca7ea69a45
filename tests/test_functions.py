import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from decoylog.functions import events as E
from decoylog.functions import text as X
from decoylog.functions.ip import ip_key, ip_number, number_key


def value_of(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "stripped"),
    [(" a b ", "a b"), ("\t x　﻿", "x"), ("\x0b\x0c", ""), ("a", "a"), (None, None)],
)
def test_strip_knows_unicode_white_space(spark, text, stripped):
    assert value_of(spark, X.strip(F.col("s")), s=text) == stripped


@pytest.mark.parametrize(
    ("data", "request_text"),
    [
        ("GET /a HTTP/1.1\r\nHost: h.test\r\n", "GET h.test/a"),
        ("GET /a HTTP/1.1\\r\\nHost: h.test\\r\\n", "GET h.test/a"),
        ("post /x HTTP/1.1\nhost:  k.test \n", "POST k.test/x"),
        ("POST /GET HTTP/1.0", "GET unknown/GET"),
        ("get /x http/1.0", "POST unknown/x"),
        ("GET /a HTTP/1.1\r\nHost: 　 \r\n", "GET /a"),
        ("GET /a HTTP", "GET unknown/a"),
        ("PUT /a HTTP/1.1", None),
        ("GET /a b HTTP", None),
        ("binary", None),
        ("", None),
        (None, None),
    ],
)
def test_http_request(spark, data, request_text):
    assert value_of(spark, E.http_request(F.col("d")), d=data) == request_text


@pytest.mark.parametrize(
    ("user", "password", "joined", "shown_user", "shown_password"),
    [
        ("root", "1", "root:1", "root", "1"),
        (None, "", "unknown:unknown", "unknown", "unknown"),
        ("a", "b:c", "a:b:c", "a", "b"),
        ("a:b", "c", "a:b:c", "a", "b"),
        (":", "x", "::x", "unknown", "unknown"),
    ],
)
def test_credentials(spark, user, password, joined, shown_user, shown_password):
    cred = E.credential(F.col("u"), F.col("p"))
    row = F.struct(cred, E.credential_part(cred, 1), E.credential_part(cred, 2))
    assert tuple(value_of(spark, row, u=user, p=password)) == (joined, shown_user, shown_password)


def test_commands_are_cut_after_a_hundred_characters(spark):
    shorten = E.short_command(F.col("c"))
    assert value_of(spark, shorten, c="x" * 100) == "x" * 100
    assert value_of(spark, shorten, c="x" * 101) == "x" * 97 + "..."


@pytest.mark.parametrize(
    ("code", "name", "severity"),
    [
        ("cowrie.login.success", "Successful Login", "success"),
        ("cowrie.login.failed", "Failed Login", "failed"),
        ("cowrie.session.connect", "Session Connected", "connect"),
        ("cowrie.direct-tcpip.data", "TCP Tunnel Data", "other"),
        ("custom.event", "custom.event", "other"),
        ("", "unknown", "other"),
        (None, "unknown", "other"),
    ],
)
def test_names_and_severity(spark, code, name, severity):
    row = F.struct(E.event_name(F.col("e")), E.severity(F.col("e")))
    assert tuple(value_of(spark, row, e=code)) == (name, severity)


def expected_key(text):
    if text is None or "%" in text:
        return None
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    return ("4%08x" if address.version == 4 else "6%032x") % int(address)


def test_address_keys(spark):
    rng = random.Random(7)
    texts = [
        *("", "1.2.3", "999.1.1.1", "1.2.3.4.5", "01.2.3.4", " 1.2.3.4", "abc", "1.2.3.4:", None),
        *("::", "::1", "1::", ":::", ":1", "1:", "a::b::c", "12345::", "g::", "fe80::1%eth0"),
        *("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"),
        *("1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:"),
        *("::ffff:1.2.3.4", "::FFFF:0102:0304", "2001:db8::1.2.3.4", "::1.2.3.999"),
        *("1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "0.0.0.0", "255.255.255.255"),
    ]
    for _ in range(300):
        address = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))
        texts += [str(address), address.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32)))]
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(16) << rng.choice([0, 48, 112]))))
    frame = spark.createDataFrame([(text,) for text in texts], "ip string")
    for row in frame.select("ip", ip_key(F.col("ip")).alias("key")).collect():
        assert row["key"] == expected_key(row["ip"]), row


def test_address_numbers(spark):
    row = F.struct(ip_number(F.col("ip")), number_key(ip_number(F.col("ip"))))
    assert tuple(value_of(spark, row, ip="192.0.2.1")) == (3221225985, "4c0000201")
    assert tuple(value_of(spark, row, ip="::1")) == (None, None)
