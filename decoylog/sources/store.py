"""The stored event table: parquet, written once, read by every report.

One pass over the lines fills one table, partitioned by ``line_status`` and
``event_date``.  Reading events or rejects is then a matter of partition
pruning, and a report over a time range opens only the days it covers.

:func:`load_files` keeps such a table up to date: each call loads the files that
are new or have changed since, and a file's rows are those of its newest state, in
whatever order and how often it is called.  Streams feed the same table.  What is
in it is recorded by the load ledger (:mod:`decoylog.sources.ledger`).
:func:`write_events` writes a table without a ledger, for lines at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoylog import constants as C
from decoylog.operators.listing import recent_logs
from decoylog.schema import EVENT
from decoylog.session import file_system, use_utc
from decoylog.sources import ledger
from decoylog.sources.lines import read_files
from decoylog.sources.parse import admitted, parse_lines, rejects

PARTITIONS = ("line_status", "event_date")

#: Rows of a table with a ledger.
STORED = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_modified", T.TimestampType()),
        T.StructField("file_bytes", T.LongType()),
        T.StructField("short_name", T.StringType()),
        T.StructField("layout", T.StringType()),
        T.StructField("log_date", T.DateType()),
        *EVENT,
    ]
    + [T.StructField("line_status", T.StringType()), T.StructField("event_date", T.DateType())]
)


def to_stored(lines: DataFrame, blank: bool = False) -> DataFrame:
    """Parsed lines as they are stored; raw text is kept for rejects only."""
    parsed = parse_lines(lines)
    if not blank:
        parsed = parsed.where(F.col("line_status") != C.BLANK)
    reject = F.col("line_status").isin(C.MALFORMED, C.NO_TIMESTAMP)
    return parsed.withColumns(
        {"event_date": F.to_date("ts"), "value": F.when(reject, F.col("value"))}
    )


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """There is no shuffle: input splits already hold few days each, and moving a
    whole day to one task would make the busiest day the slowest task.  Rows are
    sorted within each task so that parquet row groups hold few event codes and the
    reports' code filters can skip the others."""
    rows = rows.sortWithinPartitions(*PARTITIONS, "eventid", "ts")
    rows.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def write_events(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Parse lines and add them to the table without a ledger at ``path``.

    Appending does not look at what is there: a job that may be repeated, or that
    meets files which grow, uses :func:`load_files`.
    """
    _write(to_stored(lines), path, mode)


# --- a table with a ledger ---------------------------------------------------


def load_files(spark: SparkSession, paths: str | list[str], path: str) -> None:
    """Load the files below ``paths`` that are new or have changed into the table.

    A file that was loaded before and has another size or time now is read again as
    a whole, and its rows take the place of those it had.  Other files' rows, rejects
    and undated events stay as they are, so days may be loaded in any order, again,
    and with lines that come late.  Calls may overlap: numbers are reserved before
    files are listed, and the later number counts.
    """
    number = ledger.reserve(spark, path)
    files = ledger.new_files(spark, paths, path)
    if files.isEmpty():
        return
    rows = _put(read_files(spark, files), path, number)
    ledger.commit(ledger.with_every_file(rows, files), path, number)


def load_lines(lines: DataFrame, path: str, origin: str) -> None:
    """Add lines to the table as parts of their files, once per ``origin``.

    ``origin`` names the piece of work, as a stream's checkpoint and batch do; a
    piece that is done again after a failure adds nothing.
    """
    spark = lines.sparkSession
    if not ledger.entries(spark, path).where(F.col("origin") == origin).isEmpty():
        return
    number = ledger.reserve(spark, path)
    ledger.commit(_put(lines, path, number), path, number, whole=False, origin=origin)


def _put(lines: DataFrame, path: str, number: int) -> DataFrame:
    """Write the rows of a load; gives its ledger rows, from what has been written."""
    spark = use_utc(lines.sparkSession)
    stored = to_stored(lines, blank=True)
    missing = [f for f in STORED if f.name not in stored.columns]
    rows = stored.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    folder = f"{path}/data/load={number}"
    _write(rows.select(*STORED.fieldNames()), folder, "overwrite")
    return ledger.counted(spark.read.schema(STORED).parquet(folder))


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that count, rejects and blank lines included, with their ``load``."""
    return _rows_of(ledger.judged(ledger.entries(use_utc(spark), path)), path)


def _rows_of(found: DataFrame, path: str) -> DataFrame:
    """The rows of the current ones of judged entries.

    Only folders of loads with current rows are opened.  Rows that a later load has
    replaced are left out by a join with those few files, if there are any.
    """
    spark = found.sparkSession
    schema = T.StructType([*STORED, T.StructField("load", T.LongType())])
    used = [r["load"] for r in found.where("current").select("load").distinct().collect()]
    if not used:
        return spark.createDataFrame([], schema)
    rows = (
        spark.read.schema(schema)
        .option("basePath", f"{path}/data")
        .parquet(*[f"{path}/data/load={n}" for n in sorted(used)])
    )
    gone = found.where(~F.col("current") & F.col("load").isin(used)).select("file_name", "load")
    return rows if gone.isEmpty() else rows.join(gone, ["file_name", "load"], "left_anti")


def merge_loads(spark: SparkSession, path: str) -> None:
    """Rewrite the rows that count as one load, for fewer and larger files.

    Readers see either the loads from before or the merged one.  A load that commits
    meanwhile is in neither its rows nor its entries, and counts by itself.  The
    former data stay on disk until :func:`vacuum`.
    """
    number = ledger.reserve(spark, path)
    found = ledger.judged(ledger.entries(use_utc(spark), path))
    place = F.struct("loaded_by", "load")
    newest = [
        F.max_by(name, place).alias(name) for name in ("file_modified", "file_bytes", "loaded_by")
    ]
    merged = (
        found.where("current")
        .groupBy("file_name")
        .agg(
            *newest,
            *[F.sum(state).alias(state) for state in ledger.STATES],
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.lit(True).alias("whole"),
        )
    )
    _write(_rows_of(found, path).drop("load"), f"{path}/data/load={number}", "overwrite")
    ledger.commit(merged, path, number, kept=True)


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Delete the data of loads none of whose rows count any more; gives their numbers.

    Not while others read or load the table.  Ledgers stay: they are small, and tell
    which pieces of work are done.
    """
    files, at = file_system(spark, path)
    found = ledger.judged(ledger.entries(spark, path))
    used = {r["load"] for r in found.where("current").select("load").distinct().collect()}
    folders = files.globStatus(at(f"{path}/data/load=*")) or []
    numbers = [int(s.getPath().getName().removeprefix("load=")) for s in folders]
    gone = sorted(set(numbers) - used)
    for number in gone:
        files.delete(at(f"{path}/data/load={number}"), True)
    return gone


def _all_rows(spark: SparkSession, path: str) -> DataFrame:
    files, at = file_system(spark, path)
    if files.exists(at(f"{path}/reserved")):
        return stored_rows(spark, path)
    return use_utc(spark).read.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a stored table, with or without a ledger."""
    return admitted(_all_rows(spark, path)).drop("value", "load")


def recent_stored(spark: SparkSession, path: str, limit: int = C.RECENT_LIMIT) -> DataFrame:
    """The latest entries of a stored table, undated ones last, from as few days as hold them.

    The days' sizes come from the files' footers.  Days are taken from the newest
    backwards until they hold ``limit`` rows, and undated rows only if all days do not,
    so what is read follows the limit and not the table.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = _all_rows(spark, path).where(F.col("line_status").isin(*C.ADMITTED, C.NO_TIMESTAMP))
    sizes = rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows")).collect()
    days, held = [], 0
    for day, size in sorted(((r[0], r[1]) for r in sizes if r[0] is not None), reverse=True):
        if held >= limit:
            break
        days.append(day)
        held += size
    chosen = F.col("event_date").isin(days) if days else F.lit(False)
    if held < limit:
        chosen = chosen | F.col("event_date").isNull()
    return recent_logs(rows.where(chosen).drop("value", "load"), limit)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejects(_all_rows(spark, path))


def with_live_lines(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored events of rotated files and the events of the live file, read now."""
    return stored.unionByName(admitted(to_stored(live)).drop("value"), allowMissingColumns=True)


def stage_events(lines: DataFrame, path: str) -> DataFrame:
    """Events of ``lines`` by way of a new table at ``path``, which is the caller's.

    For reports straight from raw files: the lines are parsed once instead of
    once per part, and a lost executor costs a re-read and not a re-parse.  The
    table is written at once.
    """
    write_events(lines, path, "overwrite")
    return read_events(lines.sparkSession, path)
