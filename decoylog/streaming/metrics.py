"""Running counts and closed hourly session counts."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decoylog import constants as C
from decoylog.functions.events import event_name
from decoylog.functions.text import present
from decoylog.functions.times import interval_text, millis
from decoylog.operators.traffic import session_counts
from decoylog.session import file_system
from decoylog.streaming.sinks import newest_text, put_text, trigger

DEFAULT_DELAY = timedelta(hours=2)
_NO_PROGRESS = {"seen": -(1 << 60), "closed": -(1 << 60), "late": 0, "open": []}


def closed_sessions(
    events: DataFrame,
    interval: timedelta = timedelta(hours=1),
    delay: timedelta = DEFAULT_DELAY,
) -> DataFrame:
    """Sessions per interval, given out once when the interval is over.

    For append mode.  An event that arrives more than ``delay`` behind the
    newest one is left out.
    """
    return session_counts(events.withWatermark("ts", interval_text(delay)), interval)


def start_closed_sessions(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval: timedelta = timedelta(hours=1),
    delay: timedelta = DEFAULT_DELAY,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Closed intervals as :func:`closed_sessions` gives them, and what came too late.

    Tables below ``path``, by batch: ``open`` holds the counts of each batch, ``closed``
    the sums of the intervals that were over with it, ``late`` whole session events of
    intervals that were over before.  An interval is over when the newest time seen in
    earlier batches is ``delay`` past its end.  ``progress`` has the times and the
    number of late events so far; its file, written last, makes a batch count.  Counts
    of batches all of whose intervals are over are deleted.
    """
    length = millis(interval)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, last = newest_text(spark, f"{path}/progress", batch_id) or (0, _NO_PROGRESS)
        ends = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(length)) + length
        late = ends <= F.lit(last["closed"])
        sessions = (
            batch.where(F.col("eventid").isin(C.SESSION_CONNECT, C.SESSION_CLOSED))
            .where(F.col("ts").isNotNull())
        )
        seen = batch.agg(F.max(F.unix_millis("ts")).alias("seen")).first()["seen"]
        sessions.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        here = f"{path}/open/batch_id={batch_id}"
        session_counts(sessions.where(~late), interval).write.mode("overwrite").parquet(here)
        counts = spark.read.parquet(here)
        newest = counts.agg(F.max(F.unix_millis("interval_start"))).first()[0]
        behind = spark.read.parquet(f"{path}/late/batch_id={batch_id}").count()

        seen = max(x for x in (seen, last["seen"], _NO_PROGRESS["seen"]) if x is not None)
        closed = max(last["closed"], (seen - millis(delay)) // length * length)
        batches = [*last["open"], *([[batch_id, newest + length]] if newest is not None else [])]
        over = F.unix_millis("interval_start") + length
        sums = [F.sum(name).alias(name) for name in ("connects", "disconnects")]
        done = counts.limit(0)
        if batches:
            folders = [f"{path}/open/batch_id={n}" for n, _ in batches]
            done = spark.read.schema(counts.schema).parquet(*folders)
        done = done.where((over > last["closed"]) & (over <= closed))
        done.groupBy("interval_start").agg(*sums).write.mode("overwrite").parquet(
            f"{path}/closed/batch_id={batch_id}"
        )
        state = {
            "seen": seen, "closed": closed, "late": last["late"] + behind,
            "open": [[n, end] for n, end in batches if end > closed],
        }
        put_text(spark, f"{path}/progress/{batch_id}.json", json.dumps(state))
        files, at = file_system(spark, path)
        # The batch may run again from the progress before, which lists what it needs.
        kept = {n for n, _ in [*last["open"], *batches]}
        for status in files.globStatus(at(f"{path}/open/batch_id=*")):
            if int(status.getPath().getName().removeprefix("batch_id=")) not in kept:
                files.delete(status.getPath(), True)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return trigger(writer, processing_time).start()


def late_events(spark: SparkSession, path: str) -> int:
    """How many session events came after their interval was closed."""
    found = newest_text(spark, f"{path}/progress")
    return found[1]["late"] if found else 0


def corrected_sessions(
    spark: SparkSession, path: str, interval: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Closed intervals with the late events folded in: what the batch operator gives.

    An interval whose events all came late is among them.
    """
    closed = spark.read.parquet(f"{path}/closed").drop("batch_id")
    late = session_counts(spark.read.parquet(f"{path}/late").drop("batch_id"), interval)
    sums = [F.sum(name).alias(name) for name in ("connects", "disconnects")]
    return closed.unionByName(late).groupBy("interval_start").agg(*sums)


def running_sessions(
    events: DataFrame, interval: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Sessions per interval so far, open ones included (update mode).

    Nothing is left out as late; the state is one row per interval with sessions.
    """
    return session_counts(events.where(F.col("ts").isNotNull()), interval)


def running_type_counts(events: DataFrame) -> DataFrame:
    """Events per display name so far (update or complete mode).

    State grows with the number of event codes.
    """
    return events.groupBy(event_name(F.col("eventid")).alias("event_name")).agg(
        F.count(F.lit(1)).alias("count")
    )


def running_ip_counts(events: DataFrame) -> DataFrame:
    """Activity per source address so far (update or complete mode).

    State grows with the number of addresses ever seen; it is partitioned by
    address and partial counts are merged before the shuffle.
    """
    return (
        events.where(present(F.col("src_ip")))
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
