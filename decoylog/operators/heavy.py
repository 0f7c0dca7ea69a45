"""Top lists without counting every key, with a proof that they are exact.

A bounded sketch of the frequent keys is made where the events are, and sketches of
hours or tasks merge.  Its keys are candidates only: they are counted exactly, in a
second look at the events.  A key that is no candidate cannot have more than what is
left of all events once the candidates' are taken off, nor more than the sketch's own
error; if the last row of the list has more than that, no other key belongs in it.
Otherwise every key is counted.  The list is the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.text import present
from decoylog.operators.rollup import hour_of

#: Keys that a sketch keeps.
TRACKED = 10_000


def hourly_sketches(events: DataFrame, column: str, tracked: int = TRACKED) -> DataFrame:
    """hour, n and a sketch of the column's frequent values, to store and merge."""
    return (
        events.where(present(F.col(column)))
        .groupBy(hour_of(F.col("ts")).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k_accumulate(`{column}`, {tracked})").alias("sketch"),
        )
    )


def candidates(sketches: DataFrame, tracked: int = TRACKED) -> tuple[DataFrame, int]:
    """The values that merged sketches name, at most ``tracked``, and all rows' number."""
    # By a constant, since a partition without rows has no sketch to combine.
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch")
    )
    total = (merged.first() or {"n": 0})["n"]
    named = merged.select(F.inline(F.expr(f"approx_top_k_estimate(sketch, {tracked})")))
    return named.select(F.col("item").alias("key")), total


def sketch_error(total: int, tracked: int) -> float:
    """The most that a value may have which merged sketches do not name.

    A sketch's table has the power of two of places that holds ``tracked`` at three
    quarters; a value's count is known to within 3.5 of all rows over the places, and
    a value is named if its least possible count is beyond that.
    """
    places = 1 << max(3, (tracked * 4 // 3 - 1).bit_length())
    return 2 * 3.5 / places * total


def top_values(
    events: DataFrame, column: str, limit: int = C.TOP_LIMIT, tracked: int = TRACKED
) -> tuple[DataFrame, bool]:
    """The ``limit`` most frequent values with their counts, and whether the sketch proved it."""
    rows = events.where(present(F.col(column))).select(F.col(column).alias("key"))
    order = (F.desc("count"), F.asc("key"))
    named, total = candidates(hourly_sketches(events, column, tracked), tracked)
    counted = rows.join(named, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    top = counted.orderBy(*order).limit(limit)
    sums = counted.agg(F.sum("count").alias("all")).first()["all"] or 0
    listed = top.agg(F.count(F.lit(1)).alias("rows"), F.min("count").alias("least")).first()
    bound = min(total - sums, sketch_error(total, tracked))
    proven = sums == total or (listed["rows"] == limit and listed["least"] > bound)
    if not proven:
        every = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
        top = every.orderBy(*order).limit(limit)
    return top.withColumnRenamed("key", column), proven
