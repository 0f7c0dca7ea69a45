"""Helpers on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, made: Column) -> DataFrame:
    """Adds the fields of a struct, which is evaluated once however often they are used.

    A generator makes them, so that filters on them run after it and projections are
    not merged into it.
    """
    return rows.select("*", F.inline(F.array(made)))
