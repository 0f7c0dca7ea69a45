"""Continuous ingest of log lines into the stored event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from decoylog.sources.store import load_lines
from decoylog.streaming.sinks import trigger


def start_ingest(
    lines: DataFrame, path: str, checkpoint: str, processing_time: str | None = None
) -> StreamingQuery:
    """Parse a stream of lines into the table that ``read_events`` reads.

    Each micro-batch is a load of its own, known by the checkpoint and its number, so
    a batch that runs again adds nothing, and ``load_files`` may feed the same table.
    Nothing is dropped as late.  Without ``processing_time`` the query works through
    all files there are and ends.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        load_lines(batch, path, f"{checkpoint}#{batch_id}")

    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return trigger(writer, processing_time).start()
