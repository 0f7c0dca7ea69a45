"""Short ordered lists: lists that a limit keeps to a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows of a limited frame as one row with one ordered array column.

    ``order`` are ascending keys.  The array is sorted by them, so it does not
    depend on which task finishes first.
    """
    items = top.select(F.struct(*order).alias("order"), F.struct(*top.columns).alias("row"))
    packed = F.sort_array(F.collect_list(F.struct("order", "row")))
    return items.agg(F.transform(packed, lambda item: item["row"]).alias(name))


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of a limited frame with their ``rank``, from 1."""
    numbered = folded(top, order, "rows").select(F.posexplode("rows").alias("position", "row"))
    return numbered.select((F.col("position") + 1).alias("rank"), "row.*")
