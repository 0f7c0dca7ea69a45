"""Addresses as sortable keys.

A key is a family digit followed by the address in fixed-width hex, so that
plain string order is address order: ``4`` + 8 digits, or ``6`` + 32 digits.
An IPv4 address written as IPv6 (``::ffff:a.b.c.d``) gets its IPv4 key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decoylog.functions.text import let

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
# Groups of up to four digits; one ``::`` at most, no lone colon at either end.
_V6 = r"^(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)([0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}$"
_V6_GROUPS = 8
_MAPPED = "00000000000000000000ffff"


def _hex(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), width, "0")


def _v4_hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    digits = F.transform(octets, lambda octet: _hex(octet.try_cast("bigint"), 2))
    return F.when(ip.rlike(_V4), F.array_join(digits, ""))


def _plain_v6(ip: Column) -> Column:
    """Lower case, and a dotted tail turned into the two groups it stands for."""

    def with_tail(tail: Column) -> Column:
        head = F.regexp_extract(ip, r"^(.*:)[^:]*$", 1)
        return F.concat(head, F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))

    dotted = let(_v4_hex(F.regexp_extract(ip, r"([^:]*)$", 1)), with_tail)
    return F.lower(F.when(ip.contains("."), dotted).otherwise(ip))


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda group: group != "")


def _v6_hex(ip: Column) -> Column:
    def expanded(text: Column) -> Column:
        zeros = F.lit(_V6_GROUPS) - F.size(_groups(text))
        filled = F.replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), zeros)))
        whole = F.when(text.contains("::"), zeros > 0).otherwise(zeros == 0)
        return F.when(text.rlike(_V6) & whole, _groups(filled))

    groups = let(_plain_v6(ip), expanded)
    return F.array_join(F.transform(groups, lambda group: F.lpad(group, 4, "0")), "")


def ip_key(ip: Column) -> Column:
    """Sort key of an address text; NULL when it is not an address."""

    def by_family(v6: Column) -> Column:
        return F.when(
            v6.startswith(_MAPPED), F.concat(F.lit("4"), F.substring(v6, 25, 8))
        ).otherwise(F.concat(F.lit("6"), v6))

    return F.when(ip.contains(":"), let(_v6_hex(ip), by_family)).otherwise(
        F.concat(F.lit("4"), _v4_hex(ip))
    )


def number_key(number: Column) -> Column:
    """Sort key of an IPv4 number."""
    return F.when(number.between(0, 0xFFFFFFFF), F.concat(F.lit("4"), _hex(number, 8)))


def ip_number(ip: Column) -> Column:
    """IPv4 address as a number, NULL for anything else."""
    return F.conv(_v4_hex(ip), 16, 10).cast("bigint")
