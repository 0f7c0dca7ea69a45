"""Text rules shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from decoylog import constants as C


def present(text: Column) -> Column:
    """Neither missing nor empty."""
    return text.isNotNull() & (text != "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_unknown(text: Column) -> Column:
    """Missing and empty both read as ``unknown``."""
    return F.coalesce(empty_to_null(text), F.lit(C.UNKNOWN))


def strip(text: Column) -> Column:
    """Trim Unicode white space, not only the blanks SQL ``trim`` removes."""
    return F.trim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    """Without any character that is not white space; stops at the first one."""
    return F.coalesce(~text.rlike(f"[^{C.WHITESPACE_CLASS}]"), F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times but that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Case-sensitive match of any part anywhere in the text."""
    return reduce(or_, [text.contains(part) for part in parts], F.lit(False))


def mentions_any(text: Column, keywords: Iterable[str]) -> Column:
    """Case-insensitive match of any keyword anywhere, also inside words."""
    return contains_any(F.lower(text), [keyword.lower() for keyword in keywords])
